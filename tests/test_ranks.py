"""Percent ranks, learned outlier limits, XML nodes from SQL, and the daily run's shared sources."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from compare import connect, difference, spark_rows, sql_rows
from pyspark.sql import functions as F

from lowtide import dims
from lowtide.checks import REGISTRY
from lowtide.operators import outliers, ranks
from lowtide.sources import benchmark_tables as tables
from lowtide.sources import discovery

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def values():
    r = random.Random(2)
    common = [(i, 7.0) for i in range(500)]  # a third of all rows
    return common + [(1000 + i, r.choice([None, float("inf"), -0.0, 0.0, r.gauss(0, 9), float(r.randint(-5, 5))])) for i in range(1000)]


@pytest.mark.parametrize("common", [1, 256, 10**9])
def test_percent_ranks_equal_those_of_one_window(spark, values, monkeypatch, common):
    monkeypatch.setattr(ranks, "COMMON", common)
    rows = spark.createDataFrame(values, "id long, x double").repartition(6)
    got = {r["id"]: r["share"] for r in ranks.with_percent_rank(rows, "x", "share").collect()}
    x = pd.Series([v for _, v in values], dtype=float)
    below = x.rank(method="min") - 1
    n = x.notna().sum()
    want = {i: None if pd.isna(b) else b / (n - 1) for (i, _), b in zip(values, below)}
    assert got == want


def test_running_counts_by_group_lie_in_several_ranges(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), r.randint(0, 400)) for _ in range(3000)]
    counts = spark.createDataFrame(rows, "g string, v int").groupBy("g", "v").count().withColumnRenamed("count", "n")
    found = ranks.running_counts(counts, ["g"], "v").collect()
    for x in found:
        assert x["below"] == sum(1 for g, v in rows if g == x["g"] and v < x["v"])
    assert len(found) == len(set(rows))


def test_only_the_totals_of_the_ranges_meet_in_one_task(spark, values):
    counts = spark.createDataFrame(values, "id long, x double").groupBy("x").agg(F.count("*").alias("n"))
    found = ranks.running_counts(counts, [], "x")
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = found._jdf.queryExecution().explainString(mode)
    single = [part for part in text.split("\n\n") if "Arguments: SinglePartition" in part]
    assert len(single) == 1 and "Input [2]: [_range" in single[0]  # a row a range


def test_limits_are_exact_whatever_the_sketch_says(spark, monkeypatch):
    monkeypatch.setattr(outliers, "SKETCH", 20)
    monkeypatch.setattr(outliers, "MARGIN", 0.2)
    r = random.Random(3)
    rows = [(g, r.gauss(i, 3) if r.random() < 0.98 else 400.0, None if r.random() < 0.2 else float(r.randint(0, 9))) for i, g in enumerate(["a", "b", None]) for _ in range(2000)]
    rows += [("one", 5.0, float("nan"))]
    got = {(x["group_value"], x["column_name"]): x for x in outliers.outliers(spark.createDataFrame(rows, "g string, x double, y double"), "g", ["x", "y"]).collect()}
    assert set(got) == {(g, c) for g in ("a", "b", None) for c in "xy"} | {("one", "x")}
    for (g, c), x in got.items():
        own = sorted(v for v in (row[1 if c == "x" else 2] for row in rows if row[0] == g) if v is not None and v == v)
        q1, q3 = own[-(-len(own) // 4) - 1], own[-(-3 * len(own) // 4) - 1]
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        assert (x["rows"], x["q1"], x["q3"], x["low_limit"], x["high_limit"]) == (len(own), q1, q3, low, high)
        assert x["outliers"] == sum(v < low or v > high for v in own)


def test_nodes_from_sql(spark):
    discovery.register_xml_nodes(spark)
    docs = [("A", "<r><x>1</x><x y='2'/></r>"), ("B", "broken <"), ("C", None), (None, "<r/>")]
    table = spark.createDataFrame(docs, "ticker string, xml_snapshot string")
    table.createOrReplaceTempView("some_documents")
    got = spark.sql("SELECT * FROM xml_nodes(TABLE(SELECT ticker, xml_snapshot FROM some_documents))")
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got.collect())) == sorted(map(key, discovery.xml_nodes(table).collect()))
    assert spark.sql("SELECT * FROM xml_nodes(TABLE(SELECT ticker, xml_snapshot FROM some_documents WHERE false))").count() == 0


def test_the_daily_run_reads_the_bars_once(spark):
    """Every bar passes a counter on its way out of the source; all sources together see it once."""
    from lowtide.checks.screens import STORED
    from lowtide.plans import daily_scan

    seen = spark.sparkContext.accumulator(0)
    bars = tables.bars(spark, SF_DIR)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    source = daily_scan.Tables(
        tickers=tables.tickers(spark, SF_DIR),
        directory=tables.directory(spark, SF_DIR),
        bars=bars.mapInArrow(count, bars.schema),
        fundamentals=tables.fundamentals(spark, SF_DIR),
    )
    from dataclasses import replace

    nothing = replace(STORED, min_price=1e9, max_price=None)  # every source is asked
    found = daily_scan.run(spark, source, dims.MARKET_FLAGS, nothing, tables.UNIVERSE_TIME)
    assert found.count() == 0 and seen.value == bars.count()
    lazy = daily_scan.catches(spark, replace(source, bars=bars), dims.MARKET_FLAGS, STORED, tables.UNIVERSE_TIME)
    eager = daily_scan.run(spark, replace(source, bars=bars), dims.MARKET_FLAGS, STORED, tables.UNIVERSE_TIME)
    assert sorted(map(repr, lazy.collect())) == sorted(map(repr, eager.collect()))


@pytest.mark.parametrize("name", ["priority_percentile", "quality_outliers"])
def test_same_rows_as_sql(spark, name):
    q = REGISTRY[name]
    assert difference(spark_rows(q.run(spark, SF_DIR)), sql_rows(connect(SF_DIR), q.sql)) is None
