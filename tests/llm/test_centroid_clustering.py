"""Clustering against plain integers over all centroids."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from lowtide.llm.centroid_clustering import Centroids, cluster, principal_axes, rotated, vectors

SCHEMA = "vec_id long, embedding array<double>, cluster string, x int"


def brute(rows, size, k, rounds, scale, seed=1):
    good = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    named = [(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in good if i is not None]
    centres = [list(v) for _, v in sorted(named)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in good]
        for j in range(len(centres)):
            own = [v for (_, v), o in zip(good, of) if o == j]
            if own:
                centres[j] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, *nearest(v)) for i, v in good]
    inertia = {}
    for _, d, j in found:
        inertia[j] = inertia.get(j, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, j, d, inertia[j], sum(inertia.values()), sha[j]) for i, d, j in found]


def rows_of(kind):
    r = random.Random(9)
    if kind == "clustered":
        centres = [[r.gauss(0, 1) for _ in range(6)] for _ in range(5)]
        rows = [(i, [x + r.gauss(0, 0.1) for x in r.choice(centres)]) for i in range(400)]
    elif kind == "ties":
        rows = [(i, [float(r.randint(-1, 1)) / 4 for _ in range(6)]) for i in range(300)]
    else:
        rows = [(i, [r.gauss(0, 10 ** r.randint(-2, 4)) for _ in range(6)]) for i in range(200)]
    rows += [(500 + i, rows[0][1]) for i in range(200)]  # one common vector
    rows += [rows[1], rows[1], (rows[2][0], rows[3][1]), (None, rows[4][1]), (800, None), (801, []), (802, [1.0] * 5)]
    return rows + [(803, [1.0] * 5 + [None]), (804, [math.nan] * 6), (805, [math.inf] + [0.0] * 5), (806, [0.0] * 6)]


@pytest.mark.parametrize("kind", ["clustered", "ties", "wide"])
def test_same_as_all_distances(spark, kind):
    rows = rows_of(kind)
    docs = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], SCHEMA).repartition(5)
    got = [tuple(r) for r in cluster(docs, size=6, k=7, scale=64, leading=2).collect()]
    order = lambda x: tuple(str(v) for v in x)
    assert sorted(got, key=order) == sorted(brute(rows, 6, 7, 3, 64), key=order)


def test_bounds_leave_few_distances_to_verify():
    r = np.random.default_rng(4)
    centres = r.integers(-500, 500, (16, 64))
    x = (centres[r.integers(0, 16, 3000)] + r.integers(-40, 40, (3000, 64))).astype(np.int64)
    axes = np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, :16]
    best, distance, verified = Centroids(centres, axes).nearest(x, *rotated(x, axes))
    every = ((x[:, None, :] - centres[None]) ** 2).sum(2)
    assert (best == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert verified < 1.1 * len(x)  # of 16 each


@pytest.mark.parametrize("scale", [1, 1 << 26])
def test_bounds_are_safe_for_any_rotation(scale):
    r = np.random.default_rng(scale)
    x = r.integers(-1, 2, (500, 8)) * scale
    centres = np.vstack((x[:5], x[:2], [[0] * 8]))  # equal centroids: the smaller number wins
    axes = np.linalg.qr(r.normal(size=(8, 8)))[0][:, :3]
    best, distance, _ = Centroids(centres, axes).nearest(x, *rotated(x, axes))
    every = ((x[:, None, :] - centres[None]) ** 2).sum(2)
    assert (best == every.argmin(1)).all() and (distance == every.min(1)).all()


def test_axes_are_orthonormal(spark):
    docs = spark.createDataFrame([(i, v, "", 1) for i, v in rows_of("clustered")], SCHEMA)
    axes = principal_axes(vectors(docs, "vec_id", "embedding", 6), 6, 4)
    assert np.allclose(axes.T @ axes, np.eye(4))


def test_few_or_no_vectors(spark):
    one = spark.createDataFrame([(1, [0.5, -0.26], "", 1)], SCHEMA)
    (got,) = cluster(one, size=2).collect()
    assert tuple(got) == (1, 0, 0, 0, 0, hashlib.sha256(b"32,-17").hexdigest())
    for rows in ([], [(1, None, "", 1)]):
        assert cluster(spark.createDataFrame(rows, SCHEMA), size=2).collect() == []
    far = spark.createDataFrame([(1, [1e30, 0.0], "", 1), (2, [1.0, 0.0], "", 1)], SCHEMA)
    assert [r["vec_id"] for r in cluster(far, size=2).collect()] == [2]
