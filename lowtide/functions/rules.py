"""Small decision rules: cache keys, schedules, windows, vendor errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lowtide import dims


def cache_key(*parts: Column) -> Column:
    """md5 over the parts joined by '|'."""
    return F.md5(F.concat_ws("|", *parts))


def is_quarter_start(day: Column) -> Column:
    return (F.dayofmonth(day) == 1) & F.month(day).isin(1, 4, 7, 10)


def quarterly_update_due(day: Column, last_update: Column, forced: bool = False) -> Column:
    """Struct (due, reason): quarter start and no update within the last 80 days."""
    age = F.datediff(day, last_update.cast("date"))
    if forced:
        return F.struct(F.lit(True).alias("due"), F.lit("Forced run requested").alias("reason"))
    due = is_quarter_start(day) & (last_update.isNull() | (age > 80))
    # fixed values: output texts
    reason = (
        F.when(~is_quarter_start(day), "Not quarter start date")
        .when(last_update.isNull(), "No previous fundamentals data found")
        .when(age > 80, F.concat(age.cast("string"), F.lit(" days since last update")))
        .otherwise(F.concat(F.lit("Last update was "), age.cast("string"), F.lit(" days ago")))
    )
    return F.struct(due.alias("due"), reason.alias("reason"))


def local_minute(utc: Column, zone: Column) -> Column:
    local = F.convert_timezone(F.lit("UTC"), zone, utc)
    return F.hour(local) * 60 + F.minute(local)


def in_scan_window(utc: Column, zone: Column, start_minute: Column, end_minute: Column) -> Column:
    return local_minute(utc, zone).between(start_minute, end_minute)


def next_scan_start(utc: Column, zone: Column, start_minute: Column) -> Column:
    """UTC time at which the market's next scan window opens."""
    local = F.convert_timezone(F.lit("UTC"), zone, utc)
    today = F.date_trunc("day", local).cast("timestamp_ntz") + F.make_dt_interval(mins=start_minute)
    start = F.when(local > today, today + F.expr("interval 1 day")).otherwise(today)
    return F.convert_timezone(zone, F.lit("UTC"), start)


def history_period(days: Column) -> Column:
    """Shortest download period that covers the wanted number of days."""
    return F.when(days <= 30, "1mo").when(days <= 90, "3mo").when(days <= 180, "6mo").otherwise("1y")


def error_status(message: Column) -> Column:
    """INACTIVE for messages that mean the listing is gone, RETRY for the rest."""
    gone = F.lower(message).rlike("delisted|not found|404|no data found")
    return F.when(message.isNotNull(), F.when(gone, "INACTIVE").otherwise("RETRY"))


def vendor_error_action(code: Column, retry_count: Column) -> Column:
    """What to do about a vendor error: inactive, fallback, retry or log."""
    by_action: dict[str, list[int]] = {}
    for number, (action, _) in dims.VENDOR_ERRORS.items():
        by_action.setdefault(action, []).append(number)
    return (
        F.when(code.isin(by_action["inactive"]), "inactive")
        .when(code.isin(by_action["fallback"]), "fallback")
        .when(code.isin(by_action["retry"]) & (retry_count < dims.MAX_RETRIES), "retry")
        .otherwise("log")
    )
