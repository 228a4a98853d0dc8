"""Joins between quotes, fundamentals, bars and dimensions.

Joins on ticker are left to Catalyst: it broadcasts a side whose measured size is under the
session's threshold and otherwise sort-merges, splitting skewed partitions at run time.
Only the fixed dimensions are broadcast by hint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lowtide import dims
from lowtide.functions import symbols


def with_fundamentals(
    quotes: DataFrame, fundamentals: DataFrame, columns: list[str], how: str = "left"
) -> DataFrame:
    return quotes.join(fundamentals.select("ticker", *columns), "ticker", how)


def orphan_count(rows: DataFrame, parents: DataFrame, key: str = "ticker") -> DataFrame:
    """Number of rows whose key has no parent; counted per key before the join."""
    per_key = rows.groupBy(key).agg(F.count("*").alias("n"))
    return per_key.join(parents.select(key), key, "left_anti").agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("orphans")
    )


def _keys(df: DataFrame, key: str) -> DataFrame:
    """Distinct keys.  Repeats are dropped in each map task, so a hot key on the lookup side
    ships one row per task; the join reuses the partitioning of this aggregate."""
    return df.select(key).distinct()


def missing_from(rows: DataFrame, other: DataFrame, key: str = "ticker") -> DataFrame:
    """Rows whose key does not occur in the other table."""
    return rows.join(_keys(other, key), key, "left_anti")


def key_difference(rows: DataFrame, other: DataFrame, key: str = "ticker") -> DataFrame:
    """Distinct keys of the first table that the other one lacks."""
    return _keys(rows, key).subtract(_keys(other, key))


def without_payload(tickers: DataFrame, raw: DataFrame, payload: str) -> DataFrame:
    """Tickers without a raw row, or only with an empty one."""
    return missing_from(tickers, raw.filter(F.col(payload).isNotNull()))


def present_in(rows: DataFrame, keys: DataFrame, key: str = "ticker") -> DataFrame:
    """Rows whose key is wanted (batched key lookup)."""
    return rows.join(_keys(keys, key), key, "left_semi")


def not_in(rows: DataFrame, other: DataFrame, key: str = "ticker") -> DataFrame:
    """SQL NOT IN: nothing is left when the other side holds a NULL key.

    Written as an anti join plus two existence tests, because Spark runs a literal NOT IN by
    broadcasting the whole other side.
    """
    keys = _keys(other, key)
    holds_null = keys.filter(F.col(key).isNull()).exists()
    unmatched = rows.join(keys.filter(F.col(key).isNotNull()), key, "left_anti")
    return unmatched.filter(~holds_null & (F.col(key).isNotNull() | ~keys.exists()))


def split_by_age(
    tickers: DataFrame, stored: DataFrame, asof, max_age_days: int
) -> DataFrame:
    """Mark each ticker as fresh (stored recently) or to be fetched."""
    limit = F.lit(asof).cast("timestamp_ntz") - F.expr(f"interval {max_age_days} days")
    recent = (
        stored.filter(F.col("payload").isNotNull() & (F.col("last_updated") > limit))
        .groupBy("ticker")
        .agg(F.lit(True).alias("_fresh"))
    )
    if max_age_days <= 0:
        return tickers.withColumn("action", F.lit("fetch"))
    return (
        tickers.join(recent, "ticker", "left")
        .withColumn("action", F.when(F.col("_fresh"), "skip").otherwise("fetch"))
        .drop("_fresh")
    )


def with_market(df: DataFrame, spark: SparkSession, exchange: str = "exchange") -> DataFrame:
    """Market type, cap floor and suffix by exchange, with the defaults for unknown ones."""
    registry = dims.registry(spark).select(
        F.col("exchange").alias(exchange), "market_type", "min_cap_usd", "suffix"
    )
    return df.join(F.broadcast(registry), exchange, "left").withColumns(
        {
            "market_type": F.coalesce("market_type", F.lit(dims.DEFAULT_MARKET_TYPE)),
            "min_cap_usd": F.coalesce("min_cap_usd", F.lit(dims.DEFAULT_MIN_CAP_USD).cast("bigint")),
            "suffix": F.coalesce("suffix", F.lit("")),
        }
    )


def with_fx(df: DataFrame, fx: DataFrame, amount: str, currency: str = "currency") -> DataFrame:
    """Amount in USD; currencies without a rate count as 1 and are flagged."""
    rates = fx.withColumnRenamed("currency", currency)
    return (
        df.join(rates, currency, "left")
        .withColumn("fx_missing", F.col("usd_rate").isNull())
        .withColumn(f"usd_{amount}", F.col(amount) * F.coalesce("usd_rate", F.lit(1.0)))
        .drop("usd_rate")
    )


def with_exchange(df: DataFrame, spark: SparkSession, ticker: str = "ticker") -> DataFrame:
    """Exchange by suffix as an equi-join on the last suffix (no theta join)."""
    registry = (
        dims.registry(spark)
        .filter(F.col("suffix") != "")
        .select(F.col("suffix").alias("_suffix"), "exchange")
    )
    return (
        df.withColumn("_suffix", symbols.suffix(F.col(ticker)))
        .join(F.broadcast(registry), "_suffix", "left")
        .withColumn("exchange", F.coalesce("exchange", F.lit("")))
        .drop("_suffix")
    )


def reuse_decisions(
    tickers: DataFrame,
    decisions: DataFrame,
    criteria_version: str,
    asof,
    ttl_hours: int,
    key: Column | None = None,
) -> DataFrame:
    """Earlier screening decisions that still hold, per ticker.

    ``decisions``: cache_key, should_skip, reason, timestamp.  The newest entry per key
    counts; a ticker without a live entry gets should_skip = false.
    """
    if key is None:
        key = F.md5(F.concat_ws("|", "ticker", F.lit("filtering"), F.lit(criteria_version)))
    limit = F.lit(asof).cast("timestamp_ntz") - F.expr(f"interval {ttl_hours} hours")
    live = (
        decisions.filter(F.col("timestamp") >= limit)
        .groupBy("cache_key")
        .agg(F.max_by(F.struct("should_skip", "reason"), F.struct("timestamp", "reason")).alias("_d"))
    )
    return (
        tickers.select("ticker", key.alias("cache_key"))
        .join(live, "cache_key", "left")
        .select(
            "ticker",
            F.coalesce("_d.should_skip", F.lit(False)).alias("should_skip"),
            F.coalesce("_d.reason", F.lit("")).alias("reason"),
            F.col("_d").isNotNull().alias("cached"),
        )
    )
