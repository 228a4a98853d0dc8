"""Technical indicators for every ticker and every day.

Cost per bar does not depend on the look-back.  Trailing *sums* are differences of
running sums, and trailing *extremes* over ``n`` rows are combined from short frames
of about sqrt(n) rows, so a one-year window costs about 40 steps per bar instead of 252.
Prices enter as integer ticks: running sums of integers are exact, so a recomputed
task gives the same bits whatever the order of earlier aggregation.

All frames use one layout - partitioned by ticker, ordered by day - hence one shuffle
and one sort.  A window partition holds one ticker's daily bars; the bars contract
(one row per ticker and day) bounds it by the number of calendar days, some 260 rows
a year, however many raw trades the ticker has.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRICE_SCALE = 10_000
YEAR_ROWS = 252
DAY_BITS = 17
DAY_SPAN = 1 << DAY_BITS  # days from 1790 to 2149


def _by_day():
    return Window.partitionBy("ticker").orderBy("price_date")


def _so_far():
    return _by_day().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _trailing(running: str, rows: int) -> Column:
    """Sum of the last ``rows`` values, from a running sum."""
    return F.col(running) - F.lag(running, rows, 0).over(_by_day())


def _best_of(pick, short: Column, rows: int, step: int) -> Column:
    """Extreme over ``rows`` rows from short-frame extremes that end ``step`` rows apart."""
    ends = [min(i * step, rows - step) for i in range(-(-rows // step))]
    parts = [short if end == 0 else F.lag(short, end).over(_by_day()) for end in ends]
    return pick(*parts) if len(parts) > 1 else parts[0]


def feature_panel(
    bars: DataFrame,
    *,
    price_scale: int = PRICE_SCALE,
    year_rows: int = YEAR_ROWS,
    rsi_period: int = 14,
    atr_period: int = 14,
    rvol_rows: int = 30,
    fixed_rvol_divisor: bool = False,
    patterns: bool = False,
) -> DataFrame:
    """Trailing features as of every bar.

    ``bars``: ticker, price_date, open, high, low, close, volume; unique on
    (ticker, price_date), prices not NULL except possibly high and low.  Other columns
    are carried along.  Select the features you need: Catalyst drops the unused frames.
    """
    # floor(x + 0.5) stays in double arithmetic; round() would go through BigDecimal
    tick = lambda c: F.floor(F.col(c) * price_scale + 0.5)
    step = isqrt(year_rows)
    short = _by_day().rowsBetween(-(step - 1), 0)

    ticks = bars.withColumns(
        {
            "_c": tick("close"),
            "_h": tick("high"),
            "_l": tick("low"),
            "_v": F.coalesce(F.col("volume").cast("bigint"), F.lit(0).cast("bigint")),
        }
    )

    # low and day in one integer: its minimum is the lowest low at its earliest day
    dated_low = F.col("_l") * DAY_SPAN + (F.unix_date("price_date") + DAY_SPAN // 2)
    basics = ticks.withColumns(
        {
            "n_bars": F.row_number().over(_by_day()).cast("bigint"),
            "_pc": F.lag("_c").over(_by_day()),
            "_run_c": F.sum("_c").over(_so_far()),
            "_run_v": F.sum("_v").over(_so_far()),
            "_short_low": F.min(dated_low).over(short),
            "_short_high": F.max("_h").over(short),
        }
    )

    change = F.coalesce(F.col("_c") - F.col("_pc"), F.lit(0).cast("bigint"))
    true_range = F.greatest(
        F.col("_h") - F.col("_l"),
        F.abs(F.col("_h") - F.col("_pc")),
        F.abs(F.col("_l") - F.col("_pc")),
    )
    zero = F.lit(0).cast("bigint")
    running = basics.withColumns(
        {
            "_run_gain": F.sum(F.greatest(change, zero)).over(_so_far()),
            "_run_loss": F.sum(F.greatest(-change, zero)).over(_so_far()),
            "_run_tr": F.sum(F.coalesce(true_range, zero)).over(_so_far()),
        }
    )

    trailing = running.withColumns(
        {
            "_gain": _trailing("_run_gain", rsi_period),
            "_loss": _trailing("_run_loss", rsi_period),
            "_tr": _trailing("_run_tr", atr_period),
            "_c50": _trailing("_run_c", 50),
            "_c200": _trailing("_run_c", 200),
            "_v20": _trailing("_run_v", 20),
            "_v30": _trailing("_run_v", rvol_rows),
            "_low": _best_of(F.least, F.col("_short_low"), year_rows, step),
            "_high": _best_of(F.greatest, F.col("_short_high"), year_rows, step),
        }
    )

    n = F.col("n_bars")
    close = F.col("_c")
    rvol_count = F.lit(rvol_rows) if fixed_rvol_divisor else F.least(n, F.lit(rvol_rows))
    mean50 = F.when(n >= 50, F.col("_c50") / F.lit(50.0 * price_scale)).otherwise(F.col("close"))
    mean200 = F.when(n >= 200, F.col("_c200") / F.lit(200.0 * price_scale)).otherwise(
        F.col("close")
    )
    # ratios from the integer sums, one division each
    sum50 = F.when(n >= 50, F.col("_c50")).otherwise(close * 50)
    sum200 = F.when(n >= 200, F.col("_c200")).otherwise(close * 200)
    both = F.col("_gain") + F.col("_loss")

    low_day = F.pmod(F.col("_low"), F.lit(DAY_SPAN)) - DAY_SPAN // 2
    low_tick = F.shiftright(F.col("_low"), DAY_BITS)

    features = {
        "price": F.col("close"),
        "low_52w": low_tick / F.lit(float(price_scale)),
        "high_52w": F.col("_high") / F.lit(float(price_scale)),
        "low_date": F.date_from_unix_date(low_day.cast("int")),
        "days_since_low": (F.unix_date("price_date") - low_day).cast("bigint"),
        "avg_volume_30d": F.col("_v30") / rvol_count,
        "rvol": F.when(F.col("_v30") > 0, F.col("_v") * rvol_count / F.col("_v30")).otherwise(0.0),
        "avg_volume_20d": F.when(n >= 20, F.col("_v20") / F.lit(20.0)).otherwise(
            F.col("_v").cast("double")
        ),
        "rsi": F.when(n <= rsi_period, 50.0).otherwise(
            F.try_divide(F.lit(100.0) * F.col("_gain"), both)
        ),
        "sma50": mean50,
        "sma200": mean200,
        "price_vs_sma50_pct": F.when(sum50 > 0, close * 50 / sum50).otherwise(1.0),
        "sma50_vs_sma200_pct": F.when(sum200 > 0, sum50 * 4 / sum200).otherwise(1.0),
        "atr_pct": F.when(n <= atr_period, 0.05).otherwise(
            F.when(close > 0, F.col("_tr") / (close * F.lit(float(atr_period)))).otherwise(0.0)
        ),
    }
    panel = trailing.withColumns(features)
    if patterns:
        panel = with_double_bottom(panel)
    return panel.drop(*[c for c in panel.columns if c.startswith("_")])


def with_double_bottom(bars: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Flag bars whose last 20 closes show two similar lows and a close above their middle.

    A strict local minimum is known one bar later, so each row first names the minimum it
    confirms; the 18 newest such rows cover the inner 18 of 20 closes.  Lows are compared as
    integer ticks: a difference of prices would carry their rounding across the tolerance.
    """
    ticks = bars.withColumn("_close", F.floor(F.col("close") * PRICE_SCALE + 0.5))
    prior = F.lag("_close", 1).over(_by_day())
    confirmed = F.when(
        (prior < F.col("_close")) & (prior < F.lag("_close", 2).over(_by_day())), prior
    )
    marked = ticks.withColumns(
        {"_bottom": confirmed, "_rows": F.row_number().over(_by_day())}
    ).withColumn(
        "_lows", F.array_sort(F.collect_list("_bottom").over(_by_day().rowsBetween(-17, 0)))
    )
    first, second = F.get("_lows", 0), F.get("_lows", 1)
    found = (F.try_divide(second - first, first) <= tolerance) & (
        F.col("_close") > (first + second) / 2
    )
    return marked.withColumn(
        "double_bottom", (F.col("_rows") >= 20) & F.coalesce(found, F.lit(False))
    ).drop("_close", "_bottom", "_rows", "_lows")


def calendar_extremes(bars: DataFrame, days: int = 365) -> DataFrame:
    """52-week low and high over calendar days instead of rows, as of every bar."""
    day = F.unix_date("price_date")
    frame = Window.partitionBy("ticker").orderBy("_day").rangeBetween(-days, 0)
    return (
        bars.withColumn("_day", day)
        .withColumns(
            {"low_52w": F.min("low").over(frame), "high_52w": F.max("high").over(frame)}
        )
        .drop("_day")
    )


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key.

    An aggregate, not a ranking window: map tasks keep one candidate per key, so a hot
    key costs one row per task in the shuffle.  ``order`` must be unique within a key.
    """
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return newest.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def with_history_gate(panel: DataFrame, min_history_days: int) -> DataFrame:
    """Keep bars that have strictly more history than the minimum."""
    return panel.filter(F.col("n_bars") > min_history_days)


def daily_returns(bars: DataFrame) -> DataFrame:
    """Day-over-day change in percent, NULL for a ticker's first bar."""
    before = F.lag("close").over(_by_day())
    return bars.withColumn(
        "return_pct", F.round(F.try_divide(F.col("close") - before, before) * 100, 2)
    )


def recent_low_date(bars: DataFrame, asof, lookback_days: int = 365) -> DataFrame:
    """Day of the lowest low per ticker within the look-back; the earliest day wins a tie."""
    recent = bars.filter(
        (F.col("price_date") >= F.date_sub(F.lit(asof).cast("date"), lookback_days))
        & (F.col("price_date") <= F.lit(asof).cast("date"))
        & F.col("low").isNotNull()
    )
    return recent.groupBy("ticker").agg(
        F.min(F.struct("low", "price_date"))["price_date"].alias("low_date")
    )


def year_stats(bars: DataFrame, asof, lookback_days: int = 365) -> DataFrame:
    """MIN(low), MAX(high) per ticker over the calendar year before ``asof``."""
    day = F.lit(asof).cast("date")
    return (
        bars.filter(F.col("price_date").between(F.date_sub(day, lookback_days), day))
        .groupBy("ticker")
        .agg(F.min("low").alias("low_52w"), F.max("high").alias("high_52w"))
    )


def consistency(quotes: DataFrame, price: str = "last_price", tolerance: float = 0.01) -> DataFrame:
    """Per key: do repeated quotes agree within the tolerance of their maximum?"""
    usable = quotes.filter(F.col(price).isNotNull() & (F.col(price) != 0))
    return (
        usable.groupBy("ticker")
        .agg(F.min(price).alias("min_price"), F.max(price).alias("max_price"))
        .withColumn(
            "consistent",
            (F.col("max_price") - F.col("min_price")) < F.col("max_price") * tolerance,
        )
    )
