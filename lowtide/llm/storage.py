"""Intermediate tables in the folder that all executors share, and batches of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lowtide.session import written

__all__ = ["bounded_batches", "plain_names", "written"]

#: bytes of one Arrow batch on its way to a Python worker, which holds the batch while it slices it
BATCH_BYTES = 4 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def plain_names(df: DataFrame, *wanted: str) -> tuple[DataFrame, list[str]]:
    """The columns under names that no helper column has (``c0``, ``c1``, ...), and those of the wanted ones.

    ``toDF(*names)`` gives the own names back, so an input may have columns of any name."""
    names = df.columns
    return df.toDF(*[f"c{i}" for i in range(len(names))]), [f"c{names.index(w)}" for w in wanted]


def bounded_batches(spark: SparkSession) -> None:
    """Let the session's Arrow batches end at BATCH_BYTES, if it allows more; a row is never cut."""
    digits = spark.conf.get(_LIMIT).rstrip("b")
    if not digits.isdigit() or int(digits) > BATCH_BYTES:
        spark.conf.set(_LIMIT, str(BATCH_BYTES))
