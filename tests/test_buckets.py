"""Bucketed upserts against whole-table upserts, and what they read, shuffle and write."""

from __future__ import annotations

import random

import pytest

from lowtide.operators import buckets, merge
from lowtide.session import run_folder

SCHEMA = "k string, t bigint, v bigint"


def rows(df):
    return sorted((tuple(r) for r in df.select("k", "t", "v").collect()), key=repr)


def made(r, n, keys=60):
    return [(f"k{r.randint(0, keys)}", r.choice([None, *range(20)]), r.randint(0, 10**6)) for _ in range(n)]


@pytest.mark.parametrize("guard", [None, "t"])
def test_same_as_the_whole_table(spark, guard):
    r, path = random.Random(4), run_folder(spark, "buckets")
    first = spark.createDataFrame(made(r, 80), SCHEMA)
    buckets.create(first, path, ["k"], ["t", "v"], buckets=8)
    want = merge.upsert(first.limit(0), first, ["k"], ["t", "v"]).select("k", "t", "v")
    for n in (1, 30, 5):
        change = spark.createDataFrame([*made(r, n, keys=90), (None, 1, 1)], SCHEMA)
        buckets.upsert(change, path, ["t", "v"], guard=guard)
        change = change.filter("k IS NOT NULL")
        if guard:
            newest = merge.upsert(first.limit(0), change, ["k"], ["t", "v"]).select("k", "t", "v")
            want = merge.guarded_upsert(want, newest, ["k"], "t").select("k", "t", "v")
        else:
            want = merge.upsert(want, change, ["k"], ["t", "v"]).select("k", "t", "v")
        want = spark.createDataFrame(want.collect(), SCHEMA)
    assert rows(buckets.read(spark, path)) == rows(want)


def test_only_hit_buckets_are_written_and_the_state_is_not_shuffled(spark):
    path = run_folder(spark, "buckets")
    first = spark.range(4000).selectExpr("concat('k', id) AS k", "id AS t", "id AS v")
    buckets.create(first, path, ["k"], ["t"], buckets=16)
    before = buckets.manifest(spark, path)
    change = spark.createDataFrame([("k7", 9999, 1)], SCHEMA)
    hit = buckets.upsert(change, path, ["t"])
    after = buckets.manifest(spark, path)
    assert len(hit) == 1 and {b for b in after if after[b] != before[b]} == set(hit)
    renewed = spark.read.parquet(f"{path}/data/{after[hit[0]]}")
    assert renewed.count() < 4000 / 8 and renewed.select("_bucket").distinct().count() == 1
    assert len(renewed.inputFiles()) == 1
    ((state, own),) = buckets._parts(spark, path, set(hit))
    news = change.withColumn("_bucket", buckets.bucket_of(["k"], 16)).repartition(16, "k")
    joined = buckets.merged(state, news, ["k"])
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = joined._jdf.queryExecution().explainString(mode)
    tree = text.split("\n\n")[0]
    assert "SortMergeJoin" in tree and tree.count("Exchange") == 1 and "Bucketed: true" in text
    assert rows(buckets.read(spark, path).filter("k = 'k7'")) == [("k7", 9999, 1)]
    assert buckets.read(spark, path).count() == 4000


def test_another_session_attaches_and_many_changes_are_compacted(spark, monkeypatch):
    monkeypatch.setattr(buckets, "MOST_GENERATIONS", 3)
    path = run_folder(spark, "buckets")
    buckets.create(spark.createDataFrame([(f"k{i}", 0, i) for i in range(40)], SCHEMA), path, ["k"], ["t"], buckets=4)
    for i in range(6):
        buckets.upsert(spark.createDataFrame([(f"k{i}", 1, -i)], SCHEMA), path, ["t"])
        assert len(set(buckets.manifest(spark, path).values())) <= 3
    want = sorted([(f"k{i}", 1, -i) for i in range(6)] + [(f"k{i}", 0, i) for i in range(6, 40)], key=repr)
    assert rows(buckets.read(spark, path)) == want
    for generation in set(buckets.manifest(spark, path).values()):
        spark.sql(f"DROP TABLE lowtide_{generation}")  # external: as unknown as to a new session
    assert rows(buckets.read(spark, path)) == want
    assert buckets.upsert(spark.createDataFrame([], SCHEMA), path, ["t"]) == []
