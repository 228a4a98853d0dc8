"""What came too late: a lasting record of every batch, and the late rows themselves.

Spark drops late rows inside stateful operators and counts them in the query's progress, of which a
session keeps the last hundred entries.  ``ProgressTable`` listens and appends a row a batch to a
table.  ``split_late`` sits before the sink and puts the late rows of each batch aside.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

PROGRESS = "query string, run string, batch bigint, at string, input_rows bigint, late_rows bigint"


class ProgressTable(StreamingQueryListener):
    """Appends the progress of the session's queries to ``{path}``, a row a trigger.

    Use as a context: ``with ProgressTable(spark, path): ...``; leaving it waits until all that was
    posted has been heard."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def __enter__(self) -> ProgressTable:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        late = sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
        row = self.spark.range(1).select(
            F.lit(str(p.id)).alias("query"),
            F.lit(str(p.runId)).alias("run"),
            F.lit(p.batchId).cast("bigint").alias("batch"),
            F.lit(p.timestamp).alias("at"),
            F.lit(p.numInputRows).cast("bigint").alias("input_rows"),
            F.lit(late).cast("bigint").alias("late_rows"),
        )
        row.coalesce(1).write.mode("append").parquet(self.path)


def late_counts(spark: SparkSession, path: str, query: StreamingQuery | str) -> DataFrame:
    """``batch, input_rows, late_rows`` of all batches of a query, from its progress table.

    A trigger without data may report a batch number again."""
    name = query if isinstance(query, str) else str(query.id)
    rows = spark.read.schema(PROGRESS).parquet(path).filter(F.col("query") == name)
    return rows.groupBy("batch").agg(F.max("input_rows").alias("input_rows"), F.sum("late_rows").alias("late_rows"))


def split_late(path: str, time: str, lateness: str, write):
    """foreachBatch function: rows not later than the lateness allows go to ``write(batch, number)``, the
    others to ``{path}/late``; ``{path}/batches`` gets a row a batch with both counts.

    A row is late if its time is not after the newest time of all earlier batches less the lateness.
    That limit is found from the recorded batches, so a batch that runs again after a failure, or a
    query that starts again, decides as before.  Rows without a time are not late."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "none"
        before = _batches(spark, path).filter((F.col("query") == query) & (F.col("batch") < number))
        newest = before.agg(F.max("newest").alias("newest")).first()["newest"]
        limit = F.lit(newest).cast("timestamp_ntz") - F.expr(f"interval {lateness}")
        late = F.coalesce(F.col(time).cast("timestamp_ntz") <= limit, F.lit(False))
        batch = batch.persist()
        try:
            folder = f"run={query}/batch={number}"
            write(batch.filter(~late), number)
            batch.filter(late).write.mode("overwrite").parquet(f"{path}/late/{folder}")
            figures = batch.agg(
                F.count("*").alias("input_rows"),
                F.count_if(late).alias("late_rows"),
                F.max(F.col(time).cast("timestamp_ntz")).alias("newest"),
            )
            # the row of the batch comes last: it counts once all else is written
            figures.coalesce(1).write.mode("overwrite").parquet(f"{path}/batches/{folder}")
        finally:
            batch.unpersist()

    return run


def _batches(spark: SparkSession, path: str) -> DataFrame:
    schema = "input_rows bigint, late_rows bigint, newest timestamp_ntz, run string, batch bigint"
    try:
        found = spark.read.schema(schema).parquet(f"{path}/batches")
    except AnalysisException:  # nothing recorded yet
        found = spark.createDataFrame([], schema)
    return found.withColumnRenamed("run", "query")


def batch_figures(spark: SparkSession, path: str) -> DataFrame:
    """``query, batch, input_rows, late_rows, newest`` of every finished batch."""
    return _batches(spark, path).select("query", "batch", "input_rows", "late_rows", "newest")


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """The late rows of all finished batches, with ``run`` and ``batch``."""
    rows = spark.read.option("basePath", f"{path}/late").parquet(f"{path}/late")
    done = _batches(spark, path).select(F.col("query").alias("run"), F.col("batch").cast("int").alias("batch"))
    return rows.join(done, ["run", "batch"], "left_semi")
