"""Daily bars from trades or quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bar_aggregates(price: str, volume: Column, order: list[str]) -> list[Column]:
    """OHLCV aggregates; ``order`` decides which price is first and last.

    One numeric order column, unique within a bar, keeps the plan a hash aggregate.  Several
    columns are compared as a struct together with the price, which sorts instead.
    """
    at = F.col(order[0]) if len(order) == 1 else F.struct(*order, price)
    return [
        F.min_by(price, at).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, at).alias("close"),
        F.sum(volume).cast("bigint").alias("volume"),
    ]


def daily_bars(
    trades: DataFrame, keys: list[str], price: str, volume: Column, order: list[str]
) -> DataFrame:
    """One bar per key and day.

    All aggregates combine on the map side, so however many trades a ticker has in a day,
    each task ships one row for it.
    """
    return trades.groupBy(*keys, "price_date").agg(*bar_aggregates(price, volume, order))


def current_quotes(bars: DataFrame) -> DataFrame:
    """The newest bar per ticker in the shape of a current quote."""
    newest = bars.groupBy("ticker").agg(
        F.max_by(F.struct("close", "open", "high", "low", "volume"), "price_date").alias("b"),
        F.max("price_date").alias("day"),
    )
    return newest.select(
        "ticker",
        F.col("b.close").alias("last_price"),
        F.col("b.close").alias("close_price"),
        F.col("b.open").alias("open_price"),
        F.col("b.high").alias("high_price"),
        F.col("b.low").alias("low_price"),
        F.col("b.volume").alias("volume"),
        F.col("day").cast("timestamp_ntz").alias("last_updated"),
    )


def market_summary(bars: DataFrame, asof, days: int = 365) -> DataFrame:
    """Per ticker: the newest bar as a quote, and the lowest low and highest high of the year up to
    ``asof``, in one aggregate.  Tickers without a bar in that year have NULL there."""
    day = F.lit(asof).cast("date")
    in_year = F.col("price_date").between(F.date_sub(day, days), day)
    past = F.col("price_date") <= day
    found = bars.groupBy("ticker").agg(
        F.max_by(F.struct("close", "volume"), "price_date").alias("newest"),
        F.max_by(F.when(past, F.col("close")), F.when(past, F.col("price_date"))).alias("close_asof"),
        F.min(F.when(in_year, F.col("low"))).alias("low_52w"),
        F.max(F.when(in_year, F.col("high"))).alias("high_52w"),
        F.count_if(in_year).alias("bars_in_year"),
    )
    return found.select(
        "ticker",
        F.col("newest.close").alias("last_price"),
        F.col("newest.volume").alias("volume"),
        "close_asof",
        "low_52w",
        "high_52w",
        "bars_in_year",
    )
