"""Table state changes: inserts, upserts, updates and deletes as whole-table transforms.

Parquet has no MERGE; each operator returns the new state, to be written as a new version
(``replace_table``) or into the touched partitions only.  Keys are matched by aggregation
(``max_by``), which keeps one candidate per key and map task, so repeated copies of a hot
key never meet unreduced in one task.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lowtide.operators.indicators import latest_per_key


POINTER = "version bigint, folder string, at timestamp"


def _pointer(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """Number and folder of the current version; (0, None) if there is none."""
    try:
        row = (
            spark.read.schema(POINTER)
            .parquet(f"{path}/pointer")
            .agg(F.max(F.struct("version", "at", "folder")).alias("now"))
            .first()["now"]
        )
    except AnalysisException:  # no table yet
        return 0, None
    return (row["version"], row["folder"]) if row else (0, None)


def _point(spark: SparkSession, path: str, version: int, folder: str | None) -> None:
    row = spark.range(1).select(
        F.lit(version).cast("bigint").alias("version"),
        F.lit(folder).cast("string").alias("folder"),
        F.current_timestamp().alias("at"),
    )
    row.coalesce(1).write.mode("append").parquet(f"{path}/pointer")


def replace_table(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Make ``df`` the new state of the table at ``path``, which the plan may itself read.

    The state is written once, to a folder of its own; a one-row pointer then makes it current.
    Readers see the old state until then, and a failed write leaves it untouched."""
    version, _ = _pointer(spark, path)
    folder = f"version={version + 1:010d}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    _point(spark, path, version + 1, folder)


def read_current(spark: SparkSession, path: str) -> DataFrame | None:
    """The current state of a replaced table; None if there is none or it was dropped."""
    _, folder = _pointer(spark, path)
    return spark.read.parquet(f"{path}/{folder}") if folder else None


def drop_table(spark: SparkSession, path: str) -> None:
    """Drop a replaced table: it has no current version any more, whatever files are left."""
    version, folder = _pointer(spark, path)
    if folder:
        _point(spark, path, version + 1, None)


def retired_versions(spark: SparkSession, path: str) -> DataFrame:
    """Folders that are no longer current, with the time at which they were replaced: what a
    storage clean-up may delete once no reader uses them."""
    now, _ = _pointer(spark, path)
    if not now:
        return spark.createDataFrame([], "folder string, retired_at timestamp")
    rows = spark.read.schema(POINTER).parquet(f"{path}/pointer")
    after = rows.select((F.col("version") - 1).alias("version"), F.col("at").alias("retired_at"))
    return rows.filter("folder IS NOT NULL").join(after, "version").select("folder", "retired_at")


def replace_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Delete-and-reload of the partitions present in ``df``; the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        *partition_by
    ).parquet(path)


def save_tickers(current: DataFrame, incoming: DataFrame, now) -> DataFrame:
    """Upsert listings: market and time come from the incoming row, status is kept."""
    news = incoming.groupBy("ticker").agg(F.max("market").alias("_market"), F.lit(True).alias("_incoming"))
    stamp = F.lit(now).cast("timestamp_ntz")
    touched = F.col("_incoming").isNotNull()  # also by a row without a market
    known = current.withColumn("_known", F.lit(True))
    return known.join(news, "ticker", "full_outer").select(
        "ticker",
        F.coalesce("_market", "market").alias("market"),
        F.when(F.col("_known").isNull(), "ACTIVE").otherwise(F.col("status")).alias("status"),
        "status_message",
        F.when(touched, stamp).otherwise(F.col("last_updated")).alias("last_updated"),
    )


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Upsert of all columns: an incoming row replaces the stored one, the newest
    incoming row wins among repeats."""
    return latest_per_key(
        current.withColumn("_gen", F.lit(0)).unionByName(incoming.withColumn("_gen", F.lit(1))),
        keys,
        ["_gen", *order],
    ).drop("_gen")


def guarded_upsert(
    current: DataFrame,
    incoming: DataFrame,
    keys: list[str],
    time: str = "last_updated",
    tie_break: list[str] | None = None,
) -> DataFrame:
    """Upsert only if the incoming row is not older; it wins on equal times."""
    return latest_per_key(
        current.withColumn("_gen", F.lit(0)).unionByName(incoming.withColumn("_gen", F.lit(1))),
        keys,
        [time, "_gen", *(tie_break or [])],
    ).drop("_gen")


def new_rows_only(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key is not stored yet (insert, ignore existing)."""
    return incoming.join(current.select(*keys).distinct(), keys, "left_anti")


def update_status(tickers: DataFrame, updates: DataFrame, now, order: list[str]) -> DataFrame:
    """Set status, message and time of the named tickers; unknown tickers are ignored.

    Of several updates of one ticker the last by ``order`` counts."""
    change = updates.groupBy("ticker").agg(
        F.max_by(F.struct("status", "status_message"), F.struct(*order)).alias("_new")
    )
    hit = F.col("_new").isNotNull()
    return tickers.join(change, "ticker", "left").select(
        "ticker",
        "market",
        F.when(hit, F.col("_new.status")).otherwise(F.col("status")).alias("status"),
        F.when(hit, F.col("_new.status_message"))
        .otherwise(F.col("status_message"))
        .alias("status_message"),
        F.when(hit, F.lit(now).cast("timestamp_ntz"))
        .otherwise(F.col("last_updated"))
        .alias("last_updated"),
    )


def set_active_flags(tickers: DataFrame, validation: DataFrame, exchange: str) -> DataFrame:
    """Set ``is_active`` from a validation result (ticker, is_valid), for one exchange."""
    verdict = validation.groupBy("ticker").agg(F.bool_and("is_valid").alias("_valid"))
    applies = (F.col("market") == exchange) & F.col("_valid").isNotNull()
    return (
        tickers.join(verdict, "ticker", "left")
        .withColumn("is_active", F.when(applies, F.col("_valid")).otherwise(F.col("is_active")))
        .drop("_valid")
    )


def deactivate_stale(fundamentals: DataFrame, asof, days_old: int = 90) -> DataFrame:
    """Mark rows older than the limit inactive; ``was_marked`` tells which (for the count)."""
    cutoff = F.lit(asof).cast("timestamp_ntz") - F.expr(f"interval {days_old} days")
    stale = F.coalesce(F.col("last_updated") < cutoff, F.lit(False))
    return fundamentals.withColumn("was_marked", stale).withColumn(
        "is_active", F.when(F.col("was_marked"), False).otherwise(F.col("is_active"))
    )


def update_columns(
    current: DataFrame, changes: DataFrame, key: str, columns: list[str], order: list[str]
) -> DataFrame:
    """Overwrite some columns where a change exists; a NULL in the change keeps the old value.

    Of several changes of one key the last by ``order`` counts."""
    newest = changes.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_new"))
    renamed = newest.select(key, *[F.col("_new")[c].alias(f"_new_{c}") for c in columns])
    return current.join(renamed, key, "left").select(
        *[
            F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c)
            for c in current.columns
        ]
    )


def reload_scope(current: DataFrame, reloaded: DataFrame, in_scope: Column) -> DataFrame:
    """Delete the rows in scope, then add the reloaded ones."""
    return current.filter(~F.coalesce(in_scope, F.lit(False))).unionByName(reloaded)


def drop_expired(entries: DataFrame, ttl: DataFrame, asof) -> DataFrame:
    """Remove entries older than the TTL of their type; types without a TTL are kept."""
    age_limit = F.lit(asof).cast("timestamp_ntz") - F.make_dt_interval(hours=F.col("ttl_hours"))
    return (
        entries.join(ttl, "data_type", "left")
        .filter(F.col("ttl_hours").isNull() | (F.col("timestamp") >= age_limit))
        .drop("ttl_hours")
    )


def repair_ids(listing: DataFrame, key: str = "ticker") -> DataFrame:
    """Drop plain '.NSE' ids that would clash, then shorten '.NS.NSE' to '.NSE'."""
    clash = F.col(key).rlike(r"\.NSE$") & ~F.col(key).rlike(r"\.NS\.NSE$")
    return (
        listing.filter(~F.coalesce(clash, F.lit(False)))
        .withColumn(key, F.regexp_replace(key, r"\.NS\.NSE", ".NSE"))
    )


def split_raw(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split one raw landing table into quotes (with promoted fields) and documents."""
    doc = F.from_json(
        "market_data",
        "last string, bid string, ask string, volume string, avgVolume string, timestamp string",
    )
    quotes = (
        raw.filter(F.col("market_data").isNotNull())
        .withColumn("_doc", doc)
        .select(
            "ticker",
            "market_data",
            F.col("_doc.last").try_cast("double").alias("last_price"),
            F.col("_doc.bid").try_cast("double").alias("bid_price"),
            F.col("_doc.ask").try_cast("double").alias("ask_price"),
            F.round(F.col("_doc.volume").try_cast("double")).cast("bigint").alias("volume"),
            F.round(F.col("_doc.avgVolume").try_cast("double")).cast("bigint").alias("avg_volume"),
            F.col("_doc.timestamp").try_cast("timestamp_ntz").alias("data_timestamp"),
            "last_updated",
        )
    )
    return quotes, raw.drop("market_data")


def cleanup_summary(validation: DataFrame, exchange: str, now, notes: str) -> DataFrame:
    """One log row about a validation run."""
    return validation.agg(
        F.lit(exchange).alias("exchange"),
        F.count("*").alias("total_processed"),
        F.count_if("is_valid").alias("valid_count"),
        F.count_if(~F.col("is_valid")).alias("invalid_count"),
        F.lit(now).cast("timestamp_ntz").alias("cleaned_at"),
        F.lit(notes).alias("notes"),
    )
