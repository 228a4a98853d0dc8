"""Evidence, shrinkage of sites, and held-out accuracy."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lowtide.llm import quality_classifier
from lowtide.llm.quality_classifier import UNIT


def judge(docs, labels):
    return quality_classifier.judge(docs, labels, F.col("source"), F.concat_ws("/", "source", "lang"))


def keep_good(docs, labels):
    return quality_classifier.keep_good(docs, labels, F.col("source"), F.concat_ws("/", "source", "lang"))


def _corpus(n=600, seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    docs, labels = [], []
    for i in range(n):
        good, toxic = r.random() < 0.7, r.random() < 0.2
        words = [word() for _ in range(r.randint(60, 200))]
        if not good:
            words = [w.upper() + "!!" for w in words] if r.random() < 0.5 else [w + "***" for w in words[:10]] * 9
        if toxic:
            for _ in range(6):
                words[r.randrange(len(words))] = r.choice(["vile", "wretch"])
        # the site of bad documents is mostly another one
        host = "good.example" if (r.random() < 0.9) == good else "bad.example"
        docs.append((i, " ".join(words), r.choice(["en", "de"]), host))
        if i % 2:
            labels.append((i, int(good), int(toxic)))
    return docs, labels, {i: (d, i) for i, d in enumerate(docs)}


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels, _ = _corpus()
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_labels_held_out(spark, tables):
    docs, labels = tables
    halves = labels.withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)))
    got = judge(docs, halves.where("half = 0").drop("half"))
    rows = got.join(halves.where("half = 1"), "doc_id").collect()
    assert len(rows) > 100
    right = sum(r["kept"] == bool(r["quality"] and not r["toxic"]) for r in rows)
    assert right >= 0.95 * len(rows)


def test_small_sites_are_shrunk(spark):
    """The rate of a site with few documents stays near its parent's, that of a large one does not."""
    rows = [("h1", "h1/a", 900_000)] * 300 + [("h2", "h2/a", 200_000)] * 300 + [("h3", "h3/a", 200_000)] * 2
    rows += [("h4", "h4/a", 850_000)] * 200 + [("h4", "h4/b", 300_000)]
    scored = spark.createDataFrame(rows, "_host string, _path string, _p long")
    got = {r["_path"]: r["m"] for r in quality_classifier._posterior(scored).groupBy("_path").agg(F.avg("_prior").alias("m")).collect()}
    assert got["h1/a"] > 0.85 * UNIT and got["h2/a"] < 0.25 * UNIT
    assert got["h2/a"] < got["h3/a"] < 0.7 * UNIT
    assert got["h4/b"] > 0.6 * UNIT  # its only document is left out, so the host speaks


def test_odds_are_combined(spark):
    rows = [("a", "a/x", 500_000)] * 50 + [("b", "b/x", 900_000)] * 50 + [("a", "a/x", 100_000)] * 50
    got = quality_classifier._posterior(spark.createDataFrame(rows, "_host string, _path string, _p long")).collect()
    mean = sum(p for _, _, p in rows) / len(rows) / UNIT
    for r in got:
        p, q = r["_p"] / UNIT, r["_prior"] / UNIT
        odds = p / (1 - p) * q / (1 - q) / (mean / (1 - mean))
        assert r["_posterior"] == pytest.approx(odds / (1 + odds) * UNIT, abs=2)


def test_odd_rows(spark, tables):
    docs, labels = tables
    extra = [(None, None, None, None), (9001, "", "en", None), (9002, "x " * 100_000, None, "s"), (9001, "", "en", None)]
    more = docs.union(spark.createDataFrame(extra, docs.schema)).withColumn("_p_clash", F.lit(1)).withColumn("kept", F.lit("clash"))
    marks = labels.union(spark.createDataFrame([(None, 1, 0), (3, None, None), (1, 0, 1), (777_777, 1, 1)], labels.schema))
    got = judge(more, marks)
    assert got.count() == more.count()
    kept = keep_good(more, marks)
    assert kept.schema.names == more.schema.names
    assert kept.count() == got.where("kept").count()


def test_without_labels_all_rows_stay(spark, tables):
    docs, labels = tables
    got = judge(docs, labels.limit(0))
    assert got.where("kept").count() == docs.count()


def test_empty_table(spark, tables):
    docs, labels = tables
    assert judge(docs.limit(0), labels).collect() == []
    assert keep_good(docs.limit(0), labels).collect() == []
