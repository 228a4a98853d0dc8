"""The stages one after another, the registered queries, and the package without this subpackage."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from compare import connect, difference, spark_rows, sql_rows

import corpus_pipeline
from lowtide.llm import minhash_dedup, queries, quality_rules, substring_dedup

SF_DIR = "/root/testdata/sf0.001"
REPO = Path(__file__).resolve().parents[2]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, name):
    got = spark_rows(queries.QUERIES[name](spark, SF_DIR))
    assert difference(got, sql_rows(connect(SF_DIR), queries.SQL[name])) is None


def test_every_operator_has_its_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in queries.QUERIES


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").cache()
    names, counts = [], [docs.count()]
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        names.append(name)
        after = stage(spark, now, SF_DIR)
        if name != "best_fit_packing":
            assert after.schema.names == docs.schema.names
            after = spark.createDataFrame(after.collect(), docs.schema)
        if name == "quality_rules":
            want = quality_rules.measure(now).where("kept").count()
            assert after.count() == want
        if name == "minhash_dedup":
            want = {r["doc_id"] for r in minhash_dedup.near_duplicates(now, pct=corpus_pipeline.NEAR_COPY_PCT).where("kept").collect()}
            assert {r["doc_id"] for r in after.collect()} == want
        if name == "substring_dedup":
            kept = {r["doc_id"]: r["n_words"] - r["n_removed"] for r in substring_dedup.repeats(now).collect()}
            assert {r["doc_id"]: len(r["text"].split()) for r in after.collect()} == {i: n for i, n in kept.items() if n}
        counts.append(after.count())
        now = after
    assert names == ["quality_classifier", "quality_rules", "minhash_dedup", "substring_dedup", "best_fit_packing"]
    assert counts[0] > counts[1] >= counts[2] > counts[3] >= counts[4] > 0


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, SF_DIR)
    assert got.columns[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.count() > 0


def test_the_rest_works_without_the_subpackage(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and len(q) > 100; print(len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
