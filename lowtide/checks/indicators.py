"""Indicators for every ticker and day."""

from __future__ import annotations

from pyspark.sql import functions as F

from lowtide.checks.base import query, sql
from lowtide.criteria import DEFAULT
from lowtide.functions.values import rounded
from lowtide.operators import bars as bar_ops
from lowtide.operators import incremental
from lowtide.operators import indicators as ind
from lowtide.session import run_folder, written
from lowtide.sources import benchmark_tables as tables
from lowtide.sources.benchmark_tables import LAST_DAY

# a 200-day mean of ticks falls on half a millionth, so 8 digits avoid rounding ties
R = lambda *names: [rounded(F.col(n), 8).alias(n) for n in names]
SQL_R = lambda *names: ", ".join(f"round({n}, 8) AS {n}" for n in names)


def panel(spark, sf, **options):
    return ind.feature_panel(tables.bars(spark, sf), **options)


@query("daily_bars", "T-6 S-6", sql("bars", "SELECT * FROM bars"))
def daily_bars(spark, sf):
    return tables.bars(spark, sf)


@query("rsi14", "W-1", sql("panel", f"SELECT ticker, price_date, {SQL_R('rsi')} FROM panel"))
def rsi14(spark, sf):
    return panel(spark, sf).select("ticker", "price_date", *R("rsi"))


@query(
    "sma50_200",
    "W-2 W-8",
    sql(
        "panel",
        "SELECT ticker, price_date, "
        + SQL_R("sma50", "sma200", "price_vs_sma50_pct", "sma50_vs_sma200_pct")
        + " FROM panel",
    ),
)
def sma50_200(spark, sf):
    return panel(spark, sf).select(
        "ticker", "price_date", *R("sma50", "sma200", "price_vs_sma50_pct", "sma50_vs_sma200_pct")
    )


@query("atr_pct", "W-3", sql("panel", f"SELECT ticker, price_date, {SQL_R('atr_pct')} FROM panel"))
def atr_pct(spark, sf):
    return panel(spark, sf).select("ticker", "price_date", *R("atr_pct"))


@query(
    "week52_stats",
    "W-4",
    sql("panel", "SELECT ticker, price_date, low_52w, high_52w FROM panel"),
)
def week52_stats(spark, sf):
    return panel(spark, sf).select("ticker", "price_date", "low_52w", "high_52w")


@query(
    "rvol30",
    "W-5 W-6",
    sql(
        "panel",
        f"SELECT ticker, price_date, {SQL_R('rvol', 'avg_volume_20d', 'avg_volume_30d')} FROM panel",
    ),
)
def rvol30(spark, sf):
    return panel(spark, sf).select(
        "ticker", "price_date", *R("rvol", "avg_volume_20d", "avg_volume_30d")
    )


@query(
    "rvol_fixed_divisor",
    "W-5",
    sql(
        "panel",
        """SELECT ticker, price_date,
                  round(CASE WHEN v30 > 0 THEN v * 30 / v30 ELSE 0e0 END, 8) AS rvol FROM sums""",
    ),
)
def rvol_fixed_divisor(spark, sf):
    return panel(spark, sf, fixed_rvol_divisor=True).select("ticker", "price_date", *R("rvol"))


@query(
    "days_since_low",
    "W-7",
    sql("panel", "SELECT ticker, price_date, low_date, days_since_low FROM panel"),
)
def days_since_low(spark, sf):
    return panel(spark, sf).select("ticker", "price_date", "low_date", "days_since_low")


@query(
    "latest_bar",
    "W-9",
    sql(
        "bars",
        """SELECT ticker, price_date, close, volume FROM bars
           QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY price_date DESC) = 1""",
    ),
)
def latest_bar(spark, sf):
    return ind.latest_per_key(
        tables.bars(spark, sf).select("ticker", "price_date", "close", "volume"),
        ["ticker"],
        ["price_date"],
    )


@query(
    "history_gate",
    "W-10",
    sql("panel", "SELECT ticker, price_date, n_bars FROM panel WHERE n_bars > 250"),
)
def history_gate(spark, sf):
    return ind.with_history_gate(panel(spark, sf), DEFAULT.min_history_days).select(
        "ticker", "price_date", "n_bars"
    )


_BOTTOM = """
    neighbours AS (
        SELECT *, lag(c, 1) OVER w AS before1, lag(c, 2) OVER w AS before2,
               row_number() OVER w AS rn
        FROM ticks WINDOW w AS (PARTITION BY ticker ORDER BY price_date)),
    confirmed AS (
        SELECT *, CASE WHEN before1 < c AND before1 < before2 THEN before1 END AS bottom
        FROM neighbours),
    listed AS (
        SELECT *, list_sort(list_filter(list(bottom) OVER
               (PARTITION BY ticker ORDER BY price_date ROWS BETWEEN 17 PRECEDING AND CURRENT ROW),
               lambda x: x IS NOT NULL)) AS lows FROM confirmed)"""


@query(
    "double_bottom",
    "W-11",
    sql(
        "ticks",
        """SELECT ticker, price_date,
                  rn >= 20 AND coalesce(
                    (lows[2] - lows[1]) / lows[1] <= 5e-2 AND c > (lows[1] + lows[2]) / 2, FALSE)
                    AS double_bottom
           FROM listed""",
        _BOTTOM,
    ),
)
def double_bottom(spark, sf):
    return ind.with_double_bottom(tables.bars(spark, sf)).select(
        "ticker", "price_date", "double_bottom"
    )


@query(
    "daily_return_lag",
    "W-12",
    sql(
        "bars",
        """SELECT * FROM (
             SELECT ticker, price_date,
               round((close - lag(close) OVER w) / lag(close) OVER w * 100, 2) AS return_pct
             FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY price_date))
           WHERE price_date >= DATE '2001-10-05'""",
    ),
)
def daily_return_lag(spark, sf):
    return (
        ind.daily_returns(tables.bars(spark, sf))
        .filter(F.col("price_date") >= F.date_sub(F.lit(LAST_DAY).cast("date"), 30))
        .select("ticker", "price_date", "return_pct")
    )


PANEL_SQL = sql(
    "panel",
    """SELECT ticker, price_date, n_bars, price, volume, low_52w, high_52w, days_since_low, """
    + SQL_R(
        "rvol", "avg_volume_20d", "rsi", "sma50", "sma200", "price_vs_sma50_pct",
        "sma50_vs_sma200_pct", "atr_pct",
    )
    + " FROM panel",
)


def panel_columns(rows):
    return rows.select(
        "ticker", "price_date", "n_bars", "price", "volume", "low_52w", "high_52w", "days_since_low",
        *R(
            "rvol", "avg_volume_20d", "rsi", "sma50", "sma200", "price_vs_sma50_pct",
            "sma50_vs_sma200_pct", "atr_pct",
        ),
    )



@query("feature_panel", "W-16 C-19", PANEL_SQL)
def feature_panel(spark, sf):
    return panel_columns(panel(spark, sf))


NEW_DAYS = 4


@query("feature_panel_incremental", "W-16 C-19", PANEL_SQL)
def feature_panel_incremental(spark, sf):
    """The same panel from tables: a history at once, then the last days one by one."""
    bars, path = written(tables.bars(spark, sf), "bars"), run_folder(spark, "panel")
    days = [r[0] for r in bars.select("price_date").distinct().orderBy(F.desc("price_date")).limit(NEW_DAYS + 1).collect()][::-1]
    if not days:
        return panel_columns(ind.feature_panel(bars))
    history = bars.filter(F.col("price_date") <= F.lit(days[0]))
    incremental.start(history, ind.feature_panel(history), path, days[0])
    for before, day in zip(days, days[1:]):
        incremental.append_bars(bars.filter(F.col("price_date") == F.lit(day)), path)
        incremental.run_day(spark, path, before, day)
    return panel_columns(incremental.read_features(spark, path))


@query(
    "calendar_extremes",
    "J-15 W-4",
    sql(
        "bars",
        """SELECT ticker, price_date, min(low) OVER w AS low_52w, max(high) OVER w AS high_52w
           FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY price_date
             RANGE BETWEEN INTERVAL 365 DAY PRECEDING AND CURRENT ROW)""",
    ),
)
def calendar_extremes(spark, sf):
    return ind.calendar_extremes(tables.bars(spark, sf)).select(
        "ticker", "price_date", "low_52w", "high_52w"
    )


@query(
    "year_stats",
    "A-5 J-15",
    sql(
        "bars",
        """SELECT ticker, min(low) AS low_52w, max(high) AS high_52w FROM bars
           WHERE price_date BETWEEN DATE '2001-11-04' - 365 AND DATE '2001-11-04' GROUP BY ticker""",
    ),
)
def year_stats(spark, sf):
    return ind.year_stats(tables.bars(spark, sf), LAST_DAY)


@query(
    "recent_low_date",
    "A-6",
    sql(
        "bars",
        """SELECT ticker, price_date AS low_date FROM bars
           WHERE price_date BETWEEN DATE '2001-11-04' - 365 AND DATE '2001-11-04'
           QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY low, price_date) = 1""",
    ),
)
def recent_low_date(spark, sf):
    return ind.recent_low_date(tables.bars(spark, sf), LAST_DAY)


@query(
    "quote_consistency",
    "W-17",
    sql(
        "quotes",
        """SELECT ticker, min(last_price) AS min_price, max(last_price) AS max_price,
                  max(last_price) - min(last_price) < max(last_price) * 1e-2 AS consistent
           FROM (SELECT ticker || '@' || CAST(last_updated AS DATE) || '@'
                        || CAST(date_part('hour', last_updated) AS VARCHAR) AS ticker, last_price
                 FROM quotes WHERE last_price <> 0) GROUP BY ticker""",
    ),
)
def quote_consistency(spark, sf):
    from lowtide.sources.json_docs import parse_quotes

    hourly = parse_quotes(tables.raw_quotes(spark, sf)).withColumn(
        "ticker",
        F.concat_ws(
            "@", "ticker", F.to_date("last_updated").cast("string"), F.hour("last_updated").cast("string")
        ),
    )
    return ind.consistency(hourly)


@query(
    "current_quote_from_bars",
    "W-9 T-6",
    sql(
        "bars",
        """SELECT ticker, close AS last_price, open AS open_price, high AS high_price,
                  low AS low_price, volume FROM bars
           QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY price_date DESC) = 1""",
    ),
)
def current_quote_from_bars(spark, sf):
    return bar_ops.current_quotes(tables.bars(spark, sf)).drop("close_price", "last_updated")
