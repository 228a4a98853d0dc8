"""Exact centroid clustering with filtering in PCA-rotated coordinates.

Vectors are turned into integers once, so distances, means and the result are exact and do not
depend on how rows are dealt out.  An orthogonal rotation keeps distances: with the leading rotated
coordinates p and the norm r of the residual,

    |x - c|^2 >= |p_x - p_c|^2 + (r_x - r_c)^2.

1. The principal axes come from the second moments of all vectors (one aggregate of fixed size);
   the leading coordinates and the residual norm of each vector are stored beside its integers.
2. In each round the centroids are broadcast (k of them).  A task takes the centroid of least bound,
   verifies its distance in integers, and then verifies in integers only the centroids whose bound,
   less a margin for rounding, does not exceed it.  Ties go to the smaller number.
3. Tasks send sums and counts a cluster and component; means are floored exactly.

Any rotation gives the same result; a good one leaves few survivors.

Defined results: rows whose vector is null, of another length, or holds null or non-finite
components take no part, nor do those with a component beyond 2**27 after scaling, whose
distances no longer fit a long; repeated rows are vectors each; rows without an id are clustered but
never first centroids; of rows that share an id the one of least components comes first; with fewer vectors
than clusters there are as many clusters as vectors; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lowtide.llm.storage import bounded_batches, written

SCALE, SIZE, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: rotated coordinates stored
LEADING = 16
#: greatest size of a scaled component
MOST = 1 << 27
#: rows worked on at once inside a task
ROWS = 2048
#: margin for rounding, as a share of the squared norms
MARGIN = 1e-9


def vectors(rows: DataFrame, key: str, vector: str, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """``id`` and the components as integers, of the rows that take part."""
    x = rows[vector].cast("array<double>")
    # a comparison with null is null, with NaN it is false
    fine = (F.size(x) == size) & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) <= MOST / scale), F.lit(False)))
    rows = rows.select(rows[key].alias("id"), x.alias("x")).where(F.coalesce(fine, F.lit(False)))
    return rows.select("id", F.transform("x", lambda v: F.floor(scale * v)).alias("x"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).reshape(-1, size)


def first_centroids(points: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of smallest sha256 of ``seed:id``, in that order."""
    named = points.where("id IS NOT NULL").withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256))
    return np.array([r["x"] for r in named.orderBy("_h", "x").limit(k).collect()], np.int64)


def principal_axes(points: DataFrame, size: int, leading: int) -> np.ndarray:
    """The leading axes (columns) of the second moments about the mean of all vectors."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size + 1))
        for batch in batches:
            x = _matrix(batch.column("x"), size).astype(np.float64)
            x = np.hstack((x, np.ones((len(x), 1))))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["cell", "s"])

    sums = points.select("x").mapInArrow(moments, "cell int, s double").groupBy("cell").agg(F.sum("s").alias("s")).collect()
    total = np.zeros((size + 1) ** 2)
    for r in sums:
        total[r["cell"]] = r["s"]
    total = total.reshape(size + 1, size + 1)
    n = max(total[-1, -1], 1.0)
    mean = total[-1, :-1] / n
    spread = total[:-1, :-1] / n - np.outer(mean, mean)
    return np.linalg.eigh(spread)[1][:, ::-1][:, :leading]


def rotated(x: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading rotated coordinates and norm of the residual of integer vectors."""
    y = x.astype(np.float64)
    lead = y @ axes
    return lead, np.sqrt(np.maximum((y * y).sum(1) - (lead * lead).sum(1), 0.0))


def stored(points: DataFrame, axes: np.ndarray, size: int) -> DataFrame:
    """``id, x`` (little-endian integers), ``lead`` (rotated coordinates) and ``rest`` (residual norm)."""
    shared = points.sparkSession.sparkContext.broadcast(axes)
    kind = points.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), size)
            lead, rest = rotated(x, shared.value)
            columns = [_binary(x.astype("<i4")), _binary(lead.astype("<f8")), pa.array(rest)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=["id", "x", "lead", "rest"])

    return points.mapInArrow(run, f"id {kind}, x binary, lead binary, rest double")


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    offsets = pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _rows_of(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


class Centroids:
    """Integer centroids and their rotated form."""

    def __init__(self, x: np.ndarray, axes: np.ndarray):
        self.x = x
        self.lead, self.rest = rotated(x, axes)
        self.norm = (x.astype(np.float64) ** 2).sum(1)

    def nearest(self, x: np.ndarray, lead: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest centroid of every row, its squared distance, and the distances that were verified."""
        own = (lead * lead).sum(1)
        bound = np.maximum(own[:, None] + (self.lead * self.lead).sum(1) - 2 * lead @ self.lead.T, 0.0)
        bound += (rest[:, None] - self.rest) ** 2
        bound -= MARGIN * ((own + rest * rest)[:, None] + self.norm + 1.0)
        best = bound.argmin(axis=1)
        distance = ((x - self.x[best]) ** 2).sum(1)
        left = bound <= distance.astype(np.float64)[:, None] * (1 + MARGIN)
        left[np.arange(len(x)), best] = False
        row, number = np.nonzero(left)
        for i in range(0, len(row), ROWS):
            r, c = row[i : i + ROWS], number[i : i + ROWS]
            d = ((x[r] - self.x[c]) ** 2).sum(1)
            # the rows of one centroid are distinct, so centroids are compared one by one
            for j in np.unique(c):
                at = c == j
                own_rows, own_d = r[at], d[at]
                better = (own_d < distance[own_rows]) | ((own_d == distance[own_rows]) & (j < best[own_rows]))
                best[own_rows[better]], distance[own_rows[better]] = j, own_d[better]
        return best, distance, len(x) + len(row)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            part = batch.slice(i, ROWS)
            x = _rows_of(part.column("x"), "<i4").astype(np.int64)
            yield part, x, _rows_of(part.column("lead"), "<f8"), np.asarray(part.column("rest"))


def _means(points: DataFrame, now: Centroids) -> np.ndarray:
    """The centroids of the next round; a cluster without vectors keeps its own."""
    shared = points.sparkSession.sparkContext.broadcast(now)
    k, size = now.x.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, size + 1), np.int64)
        for _, x, lead, rest in _blocks(batches):
            best, _, _ = shared.value.nearest(x, lead, rest)
            for j in np.unique(best):
                own = x[best == j]
                total[j, :size] += own.sum(0)
                total[j, size] += len(own)
        cell = np.arange(total.size, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total.ravel())], names=["cell", "s"])

    sums = points.mapInArrow(run, "cell int, s long").groupBy("cell").agg(F.sum(F.col("s").cast("decimal(20,0)")).alias("s"))
    total = {r["cell"]: int(r["s"]) for r in sums.collect()}
    out = now.x.copy()
    for j in range(k):
        n = total.get(j * (size + 1) + size, 0)
        if n:
            out[j] = [total[j * (size + 1) + i] // n for i in range(size)]
    return out


def cluster(
    rows: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    size: int = SIZE,
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    seed: int = SEED,
    leading: int = LEADING,
) -> DataFrame:
    """Per vector: key, ``cluster, distance, cluster_inertia, inertia, centroid_sha256``."""
    spark = rows.sparkSession
    bounded_batches(spark)
    kind = rows.schema[key].dataType.simpleString()
    points = vectors(rows, key, vector, size, scale)
    x = first_centroids(points, k, seed)
    if not len(x):
        empty = f"`{key}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], empty)
    axes = principal_axes(points, size, min(leading, size))
    points = written(stored(points, axes, size), "vectors")
    for _ in range(rounds):
        x = _means(points, Centroids(x, axes))
    shared = spark.sparkContext.broadcast(Centroids(x, axes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own, lead, rest in _blocks(batches):
            best, distance, _ = shared.value.nearest(own, lead, rest)
            columns = [part.column("id"), pa.array(best.astype(np.int32)), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "cluster", "distance"])

    found = written(points.mapInArrow(run, f"id {kind}, cluster int, distance long"), "clusters")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()
    of = {r["cluster"]: int(r["s"]) for r in sums}
    names = [(j, of.get(j, 0), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(x.tolist())]
    table = spark.createDataFrame(names, "cluster int, cluster_inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select(
        F.col("id").alias(key), "cluster", "distance", "cluster_inertia", F.lit(sum(of.values())).cast("long").alias("inertia"), "centroid_sha256"
    )
