"""Small rows that cost much each are dealt out to all cores, and tasks hold a bounded number of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lowtide.session import spread
from lowtide.sources import benchmark_tables as tables

SF_DIR = "/root/testdata/sf0.01"


def test_tasks_hold_a_bounded_number_of_rows(spark):
    rows = spark.range(10_000).coalesce(1).select("id", F.concat(F.lit("k"), F.col("id")).alias("k"))
    dealt = spread(rows, "k", 500)
    assert dealt.rdd.getNumPartitions() == 20
    sizes = [n for (n,) in dealt.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) == 20 and sum(sizes) == 10_000 and max(sizes) < 2 * 500
    assert dealt.exceptAll(rows).isEmpty() and rows.exceptAll(dealt).isEmpty()


def test_company_documents_use_every_core(spark, monkeypatch):
    docs = tables.company_xml(spark, SF_DIR)
    assert docs.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    monkeypatch.setattr(tables, "DOCUMENTS_A_TASK", 100)
    assert tables.company_xml(spark, SF_DIR).rdd.getNumPartitions() == 16
