"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lowtide.llm.storage import written


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges (columns ``a, b``) but the roots themselves.

    Each round hangs all larger neighbours of a node on its smallest neighbour (large star) and
    then all smaller ones (small star); both are one aggregate and one join on narrow rows, so a
    node with very many edges is combined before the shuffle and split by the skew join after it.
    Rounds grow with the logarithm of a component's width.  Each round is written to the shared
    folder, which cuts the lineage and survives lost executors."""
    now = written(_pairs(edges.select("a", "b")), "edges")
    before = None
    while True:
        state = now.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")
        ).first()
        if state == before or not state["n"]:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        before = state
        now = written(_small(_large(now)), "edges")


def _pairs(edges: DataFrame) -> DataFrame:
    hi, lo = F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    return edges.where("a <> b").select(hi, lo).distinct()


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    grown = both.where("v > u").join(least, "u")
    return grown.where("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    hung = edges.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return hung.union(least.select("hi", F.col("m").alias("lo"))).distinct()
