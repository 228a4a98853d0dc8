"""Universe selection: which tickers to look at."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lowtide import dims
from lowtide.criteria import Criteria
from lowtide.functions import symbols
from lowtide.functions.rules import error_status
from lowtide.functions.text import fixed
from lowtide.operators.lookups import present_in


def _time(asof) -> Column:
    return F.lit(asof).cast("timestamp_ntz")


def _days_before(asof, days: int) -> Column:
    return _time(asof) - F.expr(f"interval {days} days")


def is_active() -> Column:
    return (F.col("status") == "ACTIVE") | F.col("status").isNull()


def actionable(tickers: DataFrame, asof, parole_days: int = 200) -> DataFrame:
    """Active tickers, and inactive ones whose last update is old enough for a retry."""
    return tickers.filter(is_active() | (F.col("last_updated") < _days_before(asof, parole_days)))


def active(tickers: DataFrame, market: str | None = None) -> DataFrame:
    scope = tickers if market is None else tickers.filter(F.col("market") == market)
    return scope.filter(is_active())


def fresh(tickers: DataFrame, asof, ttl_days: int) -> DataFrame:
    return tickers.filter(F.col("last_updated") > _days_before(asof, ttl_days))


def allowed_caps(directory: DataFrame, market: str = "market") -> DataFrame:
    """Restrict the cap category on the markets that ask for it; others pass whole."""
    return directory.filter(
        ~F.col(market).isin(*dims.CAP_FILTERED_MARKETS)
        | F.col("market_cap_category").isin(*dims.ALLOWED_CAPS)
    )


def without_small_caps(directory: DataFrame) -> DataFrame:
    """Drop the smallest categories; an unknown category drops too."""
    return directory.filter(~F.col("market_cap_category").isin(*dims.EXCLUDED_CAPS))


def seed_tickers(
    tickers: DataFrame,
    directory: DataFrame,
    exchange: str,
    source: str = "tickers",
    include_inactive: bool = False,
) -> DataFrame:
    """Input universe of a collection run: from the ticker table or from the directory."""
    if source == "tickers":
        scope = tickers.filter(F.col("market") == exchange)
        return (scope if include_inactive else scope.filter(is_active())).select("ticker")
    if source == "fd_capfilter":
        if exchange != "NSE":
            raise ValueError("the directory seed is defined for NSE only")
        return directory.filter(F.col("market_cap_category").isin(*dims.ALLOWED_CAPS)).select(
            "ticker"
        )
    raise ValueError(f"unknown source: {source}")


def selected_markets(
    spark: SparkSession, requested: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Requested market codes -> (supported ones with their registry row, unsupported ones).

    Codes are matched without regard to case, as exchange or as market flag.
    """
    codes = requested.select(F.lower(F.trim("code")).alias("code")).distinct()
    known = dims.registry(spark).select(F.lower("exchange").alias("code"), "exchange")
    flags = dims.market_flags(spark).select(
        F.col("market_flag").alias("code"), F.upper("market_flag").alias("exchange")
    )
    names = known.unionByName(flags.join(known.select("code"), "code", "left_anti"))
    supported = codes.join(F.broadcast(names), "code")
    unsupported = codes.join(F.broadcast(names), "code", "left_anti")
    return supported, unsupported


def without_repeated_failures(
    tickers: DataFrame, failures: DataFrame, limit: int = 3
) -> DataFrame:
    """Skip tickers that failed at least ``limit`` times."""
    hopeless = failures.groupBy("ticker").count().filter(F.col("count") >= limit)
    return tickers.join(hopeless, "ticker", "left_anti")


def fundamental_prefilter(tickers: DataFrame, fundamentals: DataFrame, asof) -> DataFrame:
    """Can a ticker be skipped by what is known about it?  Adds (can_skip, reason)."""
    known = fundamentals.select(
        "ticker", "exchange", "market_cap_usd", "is_active", "last_updated", F.lit(True).alias("_k")
    )
    rows = tickers.select("ticker").join(known, "ticker", "left")
    floor = symbols.min_market_cap(F.coalesce("exchange", F.lit("SMART")))
    cap = F.col("market_cap_usd")
    too_small = F.coalesce((cap != 0) & (cap < floor), F.lit(False))
    inactive = ~F.coalesce("is_active", F.lit(True))
    age = F.floor(F.timestamp_diff("DAY", F.col("last_updated"), _time(asof))).cast("bigint")
    in_millions = lambda c: F.concat(F.lit("$"), fixed(c / 1e6, 0), F.lit("M"))
    # fixed values: output texts
    reason = (
        F.when(F.col("_k").isNull(), "No cached fundamentals")
        .when(
            too_small,
            F.concat(F.lit("Market cap "), in_millions(cap), F.lit(" < threshold "), in_millions(floor)),
        )
        .when(inactive, "Stock no longer active")
        .when(age > 30, F.concat(F.lit("Data "), age, F.lit(" days old, needs refresh")))
        .otherwise("Passes fundamental filters")
    )
    can_skip = F.col("_k").isNotNull() & (too_small | inactive)
    return rows.select("ticker", can_skip.alias("can_skip"), reason.alias("reason"))


def classify_failures(failures: DataFrame) -> DataFrame:
    """Error messages -> INACTIVE for listings that are gone, RETRY for the rest."""
    return failures.withColumn("new_status", error_status(F.col("message")))


def validity(tickers: DataFrame, bars: DataFrame, asof, quick: bool = True) -> DataFrame:
    """Enough recent bars?  3 within 5 days (quick) or 200 within a year (full)."""
    days, needed, why = (
        (5, 3, "No recent trading data") if quick else (365, 200, "Insufficient historical data")
    )
    day = F.lit(asof).cast("date")
    counts = (
        bars.filter(F.col("price_date").between(F.date_sub(day, days - 1), day))
        .groupBy("ticker")
        .agg(F.count("*").alias("recent_bars"))
    )
    enough = F.coalesce("recent_bars", F.lit(0)) >= needed
    return (
        tickers.select("ticker")
        .join(counts, "ticker", "left")
        .select(
            "ticker",
            F.coalesce("recent_bars", F.lit(0)).cast("bigint").alias("recent_bars"),
            enough.alias("is_valid"),
            F.when(enough, "Valid stock").otherwise(why).alias("reason"),
        )
    )


def prices_between(bars: DataFrame, first, last, tickers: DataFrame | None = None) -> DataFrame:
    """Bars of a date range; the literal range reaches the scan as a pushed filter."""
    rows = bars.filter(
        F.col("price_date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    )
    return rows if tickers is None else present_in(rows, tickers)


def valid_quotes(quotes: DataFrame) -> DataFrame:
    return quotes.filter(F.col("last_price") > 0)


def quote_changes(quotes: DataFrame) -> DataFrame:
    """Change against the close in percent, most traded first."""
    close = F.col("close_price")
    change = F.round(F.try_divide(F.col("last_price") - close, close) * 100, 2)
    return (
        valid_quotes(quotes)
        .withColumn("change_pct", change)
        .orderBy(F.desc_nulls_last("volume"), "ticker")
    )


def large_caps(fundamentals: DataFrame, above: int) -> DataFrame:
    """Listings above a cap, largest first."""
    return fundamentals.filter(F.col("market_cap_usd") > above).orderBy(
        F.desc("market_cap_usd"), "ticker"
    )


def smallest_caps(fundamentals: DataFrame, below: int = 150_000_000, n: int = 5) -> DataFrame:
    cap = F.col("market_cap_usd")
    return fundamentals.filter((cap > 0) & (cap < below)).orderBy(cap, "ticker").limit(n)


def inactive(fundamentals: DataFrame) -> DataFrame:
    return fundamentals.filter(~F.col("is_active"))


def build_universe(
    spark: SparkSession,
    tickers: DataFrame,
    directory: DataFrame,
    enabled: dict[str, bool],
    asof,
    *,
    min_count: int = 100,
    ttl_days: int = 7,
) -> DataFrame:
    """Actionable tickers of the enabled markets.

    A market whose listing is not fresh (fewer than ``min_count`` recently updated tickers)
    is topped up from the directory; those tickers are new and therefore actionable.
    """
    markets = [row for row in dims.UNIVERSE_MARKETS if enabled.get(row[0])]
    chosen = F.broadcast(
        dims.universe_markets(spark).filter(F.col("market_flag").isin([m[0] for m in markets]))
    )
    in_scope = tickers.join(chosen.select("market"), "market", "left_semi")
    recent = in_scope.groupBy("market").agg(
        F.count_if(F.col("last_updated") > _days_before(asof, ttl_days)).alias("recent")
    )
    stale = (
        chosen.join(recent, "market", "left")
        .filter(F.coalesce("recent", F.lit(0)) < min_count)
        .select("directory_code", "market", "suffix")
    )
    listed = directory.join(
        F.broadcast(stale), directory["exchange"] == stale["directory_code"]
    ).select(
        "ticker", stale["market"], "suffix", "market_cap_category"
    )
    wanted = ~F.col("market").isin(*dims.CAP_FILTERED_MARKETS) | F.col("market_cap_category").isin(
        *dims.ALLOWED_CAPS
    )
    added = (
        listed.filter(F.coalesce(wanted, F.lit(False)))
        .select(
            symbols.append_suffix(F.col("ticker"), F.col("suffix")).alias("ticker"), "market"
        )
        .distinct()
    )
    # one full join of both sides: a listed ticker gets a new time stamp, hence no parole, and keeps
    # its status; a listed ticker that is not known yet is new
    known = tickers.join(chosen.select("market", F.lit(True).alias("_in_scope")), "market", "left")
    known = known.select("ticker", "market", "status", "last_updated", "_in_scope", F.lit(True).alias("_known"))
    both = known.join(
        added.select("ticker", F.col("market").alias("_added"), F.lit(True).alias("_listed")), "ticker", "full_outer"
    )
    actionable_ = is_active() | (
        F.col("_listed").isNull() & (F.col("last_updated") < _days_before(asof, 200))
    )
    keep = F.when(F.col("_known"), F.col("_in_scope") & actionable_).otherwise(F.col("_listed"))
    return both.filter(F.coalesce(keep, F.lit(False))).select(
        "ticker", F.when(F.col("_known"), F.col("market")).otherwise(F.col("_added")).alias("market")
    )


def union_markets(frames: list[DataFrame]) -> DataFrame:
    """Per-market lists one after another, without removing duplicates."""
    return reduce(lambda a, b: a.unionByName(b), frames)
