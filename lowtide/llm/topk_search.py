"""Exact top-k search by a three-phase uniform threshold.

A score is the inner product of two integer vectors.  The components are cut into ``LISTS`` equal
groups; the partial products of one group are the score list of that group, and a total is the sum
of its partial scores.  If a total reaches a cutoff t, at least one of its partial scores reaches
t / LISTS.  For one block of queries, which is broadcast:

1. every task gathers the heads of its local lists (k entries a list and query) with their totals;
   the k-th best total of a query over all tasks is a safe cutoff;
2. the cutoffs are broadcast (one number a query), and every task collects the entries of which a
   partial score reaches the uniform share of the cutoff - no other can be among the k best;
3. the totals of the collected entries are resolved exactly, and each task sends its k best at
   most; the k best of these, ties to the smaller id, are the answer.

Products are saved by norms: no partial score of a block of rows exceeds the product of its largest norm
in that list and the query's (Cauchy and Schwarz).  Blocks are made of rows of like norm, the
longest first; phase 1 leaves out the queries of which a block cannot raise the k best found so far, and phase 2
those of which no list of the block can reach the share.  Vectors of like norm, as of unit length, are not
spared by this.

Candidates are never shuffled or held: a task works on blocks of rows.  Queries are a stated set
that grows with the table, so they are taken in blocks of bounded size, one after another, and the
result of each block is written to the shared folder.  A group of equal vectors sends k rows a
task at most.

Defined results: rows whose id is null, or whose vector is null, empty, or holds null or
non-finite components, take no part; vectors of another length than a query's are no candidates
for it; rows that repeat an id are candidates each, but never for a query of their own id; repeated
query rows count once; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lowtide.session import run_folder

SCALE = 1024
LISTS = 2
QUERY_BLOCK, ROW_BLOCK = 1024, 2048
LEAST = np.iinfo(np.int64).min


def _valid(vector: Column) -> Column:
    def fine(x: Column) -> Column:
        return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))

    return F.coalesce((F.size(vector) > 0) & F.forall(vector, fine), F.lit(False))


def vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """The rows that take part: ``id`` and the components as doubles."""
    x = rows[vector].cast("array<double>")
    return rows.select(rows[key].cast("long").alias("id"), x.alias("x")).where(F.col("id").isNotNull() & _valid(F.col("x")))


def _integers(values: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * values).astype(np.int64)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and integer vectors of the rows, by length of the vector and at most ROW_BLOCK at once."""
    ids = np.asarray(batch.column("id"), dtype=np.int64)
    lists = batch.column("x")
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    flat = np.asarray(lists.values, dtype=np.float64)
    size = np.diff(offsets)
    for d in np.unique(size).tolist():
        rows = np.flatnonzero(size == d)
        values = _integers(flat[offsets[rows][:, None] + np.arange(d)])
        order = np.argsort(-(values.astype(np.float64) ** 2).sum(axis=1), kind="stable")
        for i in range(0, len(rows), ROW_BLOCK):
            yield ids[rows[order[i : i + ROW_BLOCK]]], values[order[i : i + ROW_BLOCK]]


def _cuts(d: int) -> list[tuple[int, int]]:
    cuts = np.linspace(0, d, LISTS + 1).astype(int)
    return list(zip(cuts, cuts[1:]))


def _norms(values: np.ndarray) -> np.ndarray:
    """Norm of each row in each list, a little too large: rows x lists."""
    squares = values.astype(np.float64) ** 2
    return np.sqrt(np.stack([squares[:, a:b].sum(axis=1) for a, b in _cuts(values.shape[1])], axis=1)) * (1 + 1e-9)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products; as doubles, which are much faster, where these are exact too."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _partials(rows: np.ndarray, queries: np.ndarray) -> list[np.ndarray]:
    """Score lists of one block: rows x queries for each group of components."""
    return [_product(rows[:, a:b], queries[:, a:b]) for a, b in _cuts(rows.shape[1])]


class Best:
    """The k best (score, id) of each query so far, ties to the smaller id."""

    def __init__(self, k: int):
        self.k = k
        self.score = np.zeros((0,), np.int64)
        self.id = np.zeros((0,), np.int64)
        self.query = np.zeros((0,), np.int64)
        self.products = 0  # rows x queries that were multiplied

    def worst(self, queries: int) -> np.ndarray:
        """The k-th best score of each query so far, or the least number there is."""
        out = np.full(queries, LEAST)
        place = np.arange(len(self.query)) - np.searchsorted(self.query, self.query, side="left")
        last = place == self.k - 1
        out[self.query[last]] = self.score[last]
        return out

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        query, ids, score = (np.concatenate(x) for x in ((self.query, query), (self.id, ids), (self.score, score)))
        order = np.lexsort((ids, -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query, side="left")
        keep = order[place < self.k]
        self.query, self.id, self.score = query[place < self.k], ids[keep], score[keep]


class Queries:
    """One block of queries by length of the vector."""

    def __init__(self, ids: np.ndarray, values: list[np.ndarray]):
        self.ids = ids
        size = np.array([len(v) for v in values])
        self.by_size = {
            int(d): (np.flatnonzero(size == d), np.stack([values[i] for i in np.flatnonzero(size == d)]))
            for d in np.unique(size)
        }


def _heads(batches: Iterator[pa.RecordBatch], queries: Queries, k: int) -> Best:
    """Phase 1 of one task: totals of the heads of its score lists."""
    best = Best(k)
    for batch in batches:
        for ids, rows in _blocks(batch):
            if rows.shape[1] not in queries.by_size:
                continue
            number, block = queries.by_size[rows.shape[1]]
            most = (_norms(rows).max(axis=0) * _norms(block)).sum(axis=1)  # no total is larger
            left = most >= best.worst(len(queries.ids))[number]
            number, block = number[left], block[left]
            best.products += len(ids) * len(number)
            parts = _partials(rows, block)
            own = ids[:, None] == queries.ids[number][None, :]
            total = sum(parts)
            seen = np.zeros(total.shape, bool)
            n = min(k + 1, len(ids))
            for part in parts:
                part = np.where(own, LEAST, part)
                head = np.argpartition(-part, n - 1, axis=0)[:n]
                np.put_along_axis(seen, head, True, axis=0)
            row, column = np.nonzero(seen & ~own)
            best.add(number[column], ids[row], total[row, column])
    return best


def _resolved(batches: Iterator[pa.RecordBatch], queries: Queries, cutoff: np.ndarray, k: int) -> Best:
    """Phases 2 and 3 of one task: entries that reach the share of the cutoff, and their totals."""
    best = Best(k)
    for batch in batches:
        for ids, rows in _blocks(batch):
            if rows.shape[1] not in queries.by_size:
                continue
            number, block = queries.by_size[rows.shape[1]]
            least = cutoff[number]
            share = np.where(least == LEAST, LEAST, -(-least // LISTS))  # partial * LISTS >= cutoff
            left = ((_norms(rows).max(axis=0) * _norms(block)) >= share[:, None]).any(axis=1)
            number, block, least, share = number[left], block[left], least[left], share[left]
            best.products += len(ids) * len(number)
            parts = _partials(rows, block)
            reach = np.zeros(parts[0].shape, bool)
            for part in parts:
                reach |= part >= share
            row, column = np.nonzero(reach)
            total = sum(part[row, column] for part in parts)
            keep = (total >= least[column]) & (ids[row] != queries.ids[number[column]])
            best.add(number[column][keep], ids[row][keep], total[keep])
    return best


def _batch(best: Best) -> pa.RecordBatch:
    columns = [pa.array(best.query), pa.array(best.id), pa.array(best.score)]
    return pa.RecordBatch.from_arrays(columns, names=["query", "vec_id", "score"])


def _best_of(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(rows: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best candidates of every row that is a query."""
    spark = rows.sparkSession
    candidates = vectors(rows, key, vector)
    asked = vectors(rows.where(is_query), key, vector).distinct()
    n_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    folder = run_folder(spark, "topk")
    schema = "query long, vec_id long, score long"
    for number in range(n_blocks):
        found = asked.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == number).orderBy("id").collect()
        queries = Queries(np.array([r["id"] for r in found], np.int64), [_integers(np.array(r["x"])) for r in found])
        shared = spark.sparkContext.broadcast(queries)

        def heads(batches, shared=shared):
            yield _batch(_heads(batches, shared.value, k))

        cutoff = np.full(len(found), LEAST)
        reached = _best_of(candidates.mapInArrow(heads, schema), k).where(F.col("rank") == k)
        for r in reached.select("query", "score").collect():
            cutoff[r["query"]] = r["score"]
        limits = spark.sparkContext.broadcast(cutoff)

        def resolve(batches, shared=shared, limits=limits):
            yield _batch(_resolved(batches, shared.value, limits.value, k))

        names = spark.createDataFrame([(i, int(v)) for i, v in enumerate(queries.ids)], "query long, query_id long")
        answer = _best_of(candidates.mapInArrow(resolve, schema), k).join(F.broadcast(names), "query")
        answer.select("query_id", F.col("rank").cast("int"), "vec_id", "score").write.mode("append").parquet(folder)
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(folder)
