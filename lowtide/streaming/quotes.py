"""Incremental quote processing on Structured Streaming.

State is kept per ticker (newest quote), per ticker and day (open bar) or per recent key
(duplicates), never per event.  Aggregates combine within each task before the state store
sees them, so a hot ticker costs one update per task and batch.  Sinks write one change folder
per batch: what a batch costs follows the batch, and one that is run again after a failure
writes the same folder again.
"""

from __future__ import annotations

import time as _clock
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from lowtide.criteria import Criteria
from lowtide.functions.times import utc_instant, utc_wall_clock
from lowtide.operators.bars import bar_aggregates
from lowtide.operators.indicators import latest_per_key
from lowtide.operators.screen import screen
from lowtide.sources.json_docs import parse_quotes

# --- sources and triggers -----------------------------------------------------------------


def parquet_stream(
    spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_batch: int = 1000
) -> DataFrame:
    """New Parquet files of a folder as a stream; bounded work per batch."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def with_cadence(writer: DataStreamWriter, every: str | None = None) -> DataStreamWriter:
    """Repeat at an interval, or work off what is there and stop."""
    if every is None:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=every)


# --- change tables ---------------------------------------------------------------------------
#
# {path}/changes/run=<query id>/batch=<number>/   rows of one micro-batch, newest per key
# {path}/commits/                                 one row per finished batch
# {path}/covers/base=<name>/                      the batches that a compaction has read
#
# A batch writes what it brings, however large the table is.  The query id is kept in the
# checkpoint, so a batch that runs again overwrites its own folder, and a new checkpoint begins
# a new run beside the old ones.  A reader takes the committed batches and the newest row per key.
# A delete is a row that says so (a tombstone): it has its time and its place in the order like any other
# change, so an older change that comes after it stays deleted and a newer one brings the key back.

COMMITS = "run string, batch bigint, seq bigint"
COVERS = "run string, batch bigint, base string"


def _commit(spark: SparkSession, path: str, run: str, number: int, seq: int) -> None:
    row = spark.range(1).select(
        F.lit(run).alias("run"), F.lit(number).cast("bigint").alias("batch"), F.lit(seq).cast("bigint").alias("seq")
    )
    row.coalesce(1).write.mode("append").parquet(f"{path}/commits")


def _committed(spark: SparkSession, path: str) -> DataFrame:
    """The batches that count: one row each, without those that a finished compaction has read."""
    rows = spark.read.schema(COMMITS).parquet(f"{path}/commits").groupBy("run", "batch").agg(F.max("seq").alias("seq"))
    try:
        covers = spark.read.schema(COVERS).parquet(f"{path}/covers")
    except AnalysisException:  # never compacted
        return rows
    covers = covers.join(rows.select(F.col("run").alias("base")), "base", "left_semi")
    return rows.join(covers, ["run", "batch"], "left_anti")


def _write_changes(rows: DataFrame, path: str, run: str, number: int) -> None:
    spark, seq = rows.sparkSession, _clock.time_ns()
    if "_deleted" not in rows.columns:
        rows = rows.withColumn("_deleted", F.lit(False))
    rows.withColumn("_seq", F.lit(seq)).write.mode("overwrite").parquet(f"{path}/changes/run={run}/batch={number}")
    _commit(spark, path, run, number, seq)


def change_sink(path: str, keys: list[str], time: str, tie_break: list[str] | None = None, deleted: str | None = None):
    """foreachBatch function: the batch, reduced to the newest row per key, as a change folder.

    ``deleted`` names a boolean column of the batch that marks deletes."""

    def write(batch: DataFrame, number: int, run: str | None = None) -> None:
        run = run or batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        rows = latest_per_key(batch, keys, [time, *(tie_break or [])])
        if deleted is not None:
            rows = rows.withColumn("_deleted", F.coalesce(deleted, F.lit(False))).drop(deleted)
        _write_changes(rows, path, run, number)

    return write


def _changes(spark: SparkSession, path: str, batches: DataFrame) -> DataFrame:
    changes = spark.read.option("basePath", f"{path}/changes").parquet(f"{path}/changes")
    return changes.join(batches.select("run", "batch"), ["run", "batch"], "left_semi")


def _newest(rows: DataFrame, keys: list[str], time: str, tie_break: list[str] | None) -> DataFrame:
    """On equal times the later batch wins, and within a batch the tie-break."""
    return latest_per_key(rows, keys, [time, "_seq", *(tie_break or [])]).drop("run", "batch")


def read_state(
    spark: SparkSession, path: str, keys: list[str], time: str, tie_break: list[str] | None = None
) -> DataFrame:
    """Newest row per key over all committed batches, without the deleted keys."""
    rows = _newest(_changes(spark, path, _committed(spark, path)), keys, time, tie_break)
    return rows.filter("NOT _deleted").drop("_seq", "_deleted")


def delete_keys(gone: DataFrame, path: str, keys: list[str], time: str, at) -> None:
    """Delete the keys named in ``gone`` as of a time: changes up to then are void, whenever they come."""
    spark = gone.sparkSession
    stored = spark.read.parquet(f"{path}/changes").schema
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in stored if f.name not in (*keys, time, "run", "batch", "_seq", "_deleted")]
    stamp = F.lit(at).cast(stored[time].dataType).alias(time)
    rows = gone.select(*keys).distinct().select(*keys, stamp, *blank, F.lit(True).alias("_deleted"))
    _write_changes(rows, path, f"delete-{uuid.uuid4().hex}", 0)


def delete_where(spark: SparkSession, path: str, keys: list[str], time: str, condition, at, tie_break: list[str] | None = None) -> None:
    """Delete the keys whose present row meets the condition (a suffix, an age), as of a time."""
    delete_keys(read_state(spark, path, keys, time, tie_break).filter(condition), path, keys, time, at)


def compact(
    spark: SparkSession, path: str, keys: list[str], time: str, tie_break: list[str] | None = None, retire_before=None
) -> None:
    """Write the newest rows as one folder that stands for the batches that were read.

    Runs beside streams: what it covers is the list of the batches it has read, so one that is committed
    meanwhile, by whatever run, still counts.  Rows keep their place in the order.  Tombstones are kept too, as an
    older change may still come; those before ``retire_before`` are dropped, which states that no change older
    than that will come any more.  The covered folders are no longer read; a storage clean-up may delete them."""
    base = f"base-{uuid.uuid4().hex}"
    listed = _committed(spark, path).select("run", "batch")
    listed.withColumn("base", F.lit(base)).coalesce(1).write.parquet(f"{path}/covers/of={base}")
    listed = spark.read.schema(COVERS).parquet(f"{path}/covers/of={base}")
    state = _newest(_changes(spark, path, listed), keys, time, tie_break)
    if retire_before is not None:
        old = F.col("_deleted") & (F.col(time) < F.lit(retire_before).cast(state.schema[time].dataType))
        state = state.filter(~old)
    state.write.mode("overwrite").parquet(f"{path}/changes/run={base}/batch=0")
    _commit(spark, path, base, 0, _clock.time_ns())


# --- streams ---------------------------------------------------------------------------------


def latest_quotes_batches(
    quotes: DataFrame, path: str, checkpoint: str, every: str | None = None, **options
) -> StreamingQuery:
    """Micro-batch flatten into a change table: newest quote per ticker, ties to the incoming row."""
    writer = parse_quotes(quotes).writeStream.foreachBatch(
        change_sink(path, ["ticker"], "last_updated", **options)
    )
    return with_cadence(writer.option("checkpointLocation", checkpoint), every).start()


def latest_quotes_state(quotes: DataFrame, order: list[str]) -> DataFrame:
    """Newest quote per ticker as streaming state; older arrivals change nothing."""
    rows = parse_quotes(quotes)
    rest = [c for c in rows.columns if c != "ticker"]
    newest = rows.groupBy("ticker").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return newest.select("ticker", *[F.col("_row")[c].alias(c) for c in rest])


def within_lateness(quotes: DataFrame, time: str = "last_updated", lateness: str = "1 hour") -> DataFrame:
    """Declare how late an event may arrive; later ones are dropped by stateful operators and
    counted in the query's progress, which ``lateness.ProgressTable`` keeps.  Watermarks need
    instants, so wall-clock times are converted."""
    if dict(quotes.dtypes)[time] == "timestamp_ntz":
        quotes = quotes.withColumn(time, utc_instant(F.col(time)))
    return quotes.withWatermark(time, lateness)


def without_duplicates(
    quotes: DataFrame,
    keys: list[str],
    time: str = "last_updated",
    lateness: str = "1 hour",
    salts: int = 8,
) -> DataFrame:
    """Drop repeats that arrive within the lateness; state is forgotten after it.

    A group of copies may be very large, so repeats are first dropped within each of ``salts``
    slices of the input; the final pass sees at most that many copies (1: no slices).
    """
    unique = within_lateness(quotes, time, lateness)
    if salts > 1:
        unique = (
            unique.withColumn("_salt", F.spark_partition_id() % salts)
            .dropDuplicatesWithinWatermark([*keys, "_salt"])
            .drop("_salt")
        )
    unique = unique.dropDuplicatesWithinWatermark(keys)
    return unique.withColumn(time, utc_wall_clock(F.col(time)))


def silent_periods(
    quotes: DataFrame, time: str = "last_updated", gap: str = "24 hours", lateness: str = "1 hour"
) -> DataFrame:
    """Freshness monitor: per ticker, the periods of activity that ended with a silence
    longer than the gap.  A period is emitted once the watermark passes its end.

    The session should merge sessions within each input partition before the shuffle
    (``lowtide.session.SETTINGS`` does), so that a ticker with very many quotes ships one row per
    partition and period; the result is the same without.
    """
    active = within_lateness(quotes, time, lateness).groupBy(
        "ticker", F.session_window(time, gap).alias("s")
    )
    return active.agg(F.count("*").alias("quotes"), F.max(time).alias("last_quote")).select(
        "ticker",
        "quotes",
        utc_wall_clock(F.col("last_quote")).alias("last_quote"),
        utc_wall_clock(F.col("s.end")).alias("stale_since"),
    )


def daily_bars(
    quotes: DataFrame,
    order: list[str],
    price: str = "last_price",
    volume: str = "volume",
    time: str = "last_updated",
    lateness: str = "1 day",
) -> DataFrame:
    """Quotes -> OHLCV bars per ticker and day; a day closes when the watermark passes it."""
    timely = within_lateness(quotes.filter(F.col(price).isNotNull()), time, lateness)
    bars = timely.groupBy("ticker", F.window(time, "1 day").alias("w")).agg(
        *bar_aggregates(price, F.coalesce(volume, F.lit(0)), order)
    )
    return bars.select(
        "ticker", utc_wall_clock(F.col("w.start")).cast("date").alias("price_date"),
        "open", "high", "low", "close", "volume",
    )


def screened_quotes(
    quotes: DataFrame, fundamentals: DataFrame, criteria: Criteria, features: DataFrame | None = None
) -> DataFrame:
    """Enrich a stream of quotes with the stored fundamentals and rolling features, and screen it.

    ``features`` has the stored rolling values per ticker; a quote's RVOL is its own volume over
    the stored 20-day average.  Without them RVOL counts as 1.  Caps are whole dollars.  The static
    sides are left to Catalyst: broadcast while they are small, else sort-merged.
    """
    known = fundamentals.select(
        "ticker",
        F.col("xml_52w_low").alias("low_52w"),
        F.col("xml_52w_high").alias("high_52w"),
        F.coalesce(F.col("mkt_cap_usd"), F.lit(0.0)).alias("usd_mcap"),
    )
    rows = (
        parse_quotes(quotes)
        .join(known, "ticker", "left")
        .withColumnsRenamed({"ticker": "symbol", "last_price": "price", "last_updated": "time"})
    )
    if features is None:
        return screen(rows.withColumn("rvol", F.lit(1.0)), criteria)
    stored = features.select(
        F.col("ticker").alias("symbol"),
        "avg_volume_20d",
        "days_since_low",
        "rsi",
        "price_vs_sma50_pct",
        "sma50_vs_sma200_pct",
        "atr_pct",
    )
    usual = F.col("avg_volume_20d")
    rows = rows.join(stored, "symbol", "left")
    return screen(
        rows.withColumn("rvol", F.when(usual > 0, F.col("volume") / usual).otherwise(F.lit(1.0))), criteria
    )


def to_parquet(
    stream: DataFrame, path: str, checkpoint: str, every: str | None = None, mode: str = "append"
) -> StreamingQuery:
    writer = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    return with_cadence(writer, every).start()


def to_changes(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    keys: list[str],
    time: str,
    every: str | None = None,
    tie_break: list[str] | None = None,
) -> StreamingQuery:
    """Updated rows of a stateful stream into a change table, read as one row per key."""
    writer = (
        stream.writeStream.outputMode("update")
        .foreachBatch(change_sink(path, keys, time, tie_break))
        .option("checkpointLocation", checkpoint)
    )
    return with_cadence(writer, every).start()
