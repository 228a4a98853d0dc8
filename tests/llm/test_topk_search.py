"""Exact top-k against all pairs."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from lowtide.llm import topk_search
from lowtide.llm.topk_search import top_k


def brute(rows, k):
    good = [
        (i, [math.floor(1024 * x) for x in v])
        for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = set()
    for q, a in {(i, tuple(v)) for i, v in good if i % 20 == 0}:
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(b) == len(a))
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])}
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    vector = lambda: [r.gauss(0, 0.3) for _ in range(7)]
    out = [(i, vector()) for i in range(300)]
    out += [(400 + i, out[4][1]) for i in range(90)]  # one common vector
    out += [(600, None), (620, []), (640, [1.0] * 6 + [None]), (660, [math.nan] * 7), (680, [math.inf] + [0.0] * 6), (700, [0.5] * 3)]
    out += [(720, [0.25] * 3), (740, [1e9, -1e9, 3.0]), (None, vector()), (7, vector()), (20, out[20][1]), (760, [0.0] * 7)]
    return out


def test_same_as_all_pairs(spark, rows, monkeypatch):
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 5)
    docs = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<double>, score string").repartition(5)
    got = [tuple(r) for r in top_k(docs, F.col("vec_id") % 20 == 0, k=4).select("query_id", "rank", "vec_id", "score").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 4)


def test_fewer_candidates_than_k(spark):
    docs = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in top_k(docs, F.col("vec_id") == 0, k=10).collect())
    assert got == [(0, 1, 1, 2 * 1024 * 1024), (0, 2, 2, 2 * 1024 * 1024)]


@pytest.mark.parametrize("rows", [[], [(0, None)], [(1, [1.0])]])
def test_no_queries(spark, rows):
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert top_k(docs, F.col("vec_id") % 20 == 0).collect() == []


def test_norms_spare_most_products():
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(3)
    length = np.repeat([1.0, 0.1, 0.01], 4000)
    x = r.normal(size=(12_000, 16)) * length[:, None]
    order = r.permutation(len(x))
    rows = [pa.RecordBatch.from_pydict({"id": pa.array(order), "x": pa.array(x[order].tolist(), pa.list_(pa.float64()))})]
    values = [topk_search._integers(x[i]) for i in range(0, 4000, 100)]
    queries = topk_search.Queries(np.arange(0, 4000, 100), values)
    first = topk_search._heads(iter(rows), queries, 10)
    cutoff = first.worst(40)
    found = topk_search._resolved(iter(rows), queries, cutoff, 10)
    whole = topk_search._integers(x) @ np.array(values).T
    for q in range(40):
        whole[100 * q, q] = np.iinfo(np.int64).min
        want = np.sort(whole[:, q])[::-1][:10]
        assert (np.sort(found.score[found.query == q])[::-1] == want).all()
    assert first.products + found.products < 0.8 * whole.size  # two for each pair without bounds
