"""Ranks and order statistics over whole tables without bringing them into one task.

Distinct values are counted first (combined within each task, so a value that a third of all rows
have is one row), dealt out by range, and summed in two passes: inside each range and over the
ranges.  No window covers more than one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lowtide.criteria import SCORE_WEIGHTS
from lowtide.session import written

#: a value counts as common from this share of all rows on; there are at most as many common values
COMMON = 256


def running_counts(counts: DataFrame, group: list[str], value: str, n: str = "n") -> DataFrame:
    """Distinct values with their counts -> the same rows with ``below``, the rows of smaller values of the group.

    Values are dealt out by range of (group, value), so a large group lies in several neighbouring
    ranges; the second pass adds what the ranges before hold, one row a range and group."""
    dealt = counts.repartitionByRange(*[F.col(c) for c in (*group, value)])
    dealt = written(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_range", *group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    if not group:
        dealt = dealt.withColumn("_all", F.lit(0))
        before = Window.partitionBy("_all").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    keys = ["_range", *(group or ["_all"])]
    totals = dealt.groupBy(*keys).agg(F.sum(n).alias("_n"))
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_n").over(before), zero)).drop("_n")
    summed = dealt.withColumn("_inside", F.coalesce(F.sum(n).over(inside), zero))
    same = [summed[c].eqNullSafe(offsets[c]) for c in keys]
    found = summed.join(offsets, same).select(
        *[summed[c] for c in (*group, value)], summed[n], (F.col("_inside") + F.col("_offset")).alias("below")
    )
    return found


def with_percent_rank(rows: DataFrame, value: str, alias: str) -> DataFrame:
    """Add the share of the other rows that have a smaller value, as ``percent_rank`` over the whole table.

    NULLs have no rank and do not count.  The ranks of common values (at most COMMON of them) are
    broadcast; the others, each less than 1 / COMMON of all rows, are joined."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("_value")).agg(F.count("*").alias("n"))
    ranked = written(running_counts(counts, [], "_value"), "ranks")
    total = ranked.agg(F.sum("n")).first()[0] or 0
    share = (F.col("below") / F.lit(float(max(total - 1, 1)))).alias(alias)
    common = F.col("n") * COMMON >= total
    often = F.broadcast(ranked.filter(common).select("_value", F.lit(True).alias("_common"), share))
    seldom = ranked.filter(~common).select("_value", share)
    same = F.col(value) == F.col("_value")
    first = rows.join(often, same, "left")
    done = first.filter(F.col("_common").isNotNull() | F.col(value).isNull()).drop("_value", "_common")
    rest = rows.join(often.select("_value"), same, "left_anti").filter(F.col(value).isNotNull())
    return done.unionByName(rest.join(seldom, same, "left").drop("_value"))


def score_parts(rows: DataFrame) -> dict[str, Column]:
    """What is ranked for each weight: the more, the better."""
    return {
        "rvol": F.col("rvol"),
        "price_proximity": -F.col("pct_from_low"),
        "volume": F.col("volume").cast("double"),
        "rsi": -F.col("rsi"),
        "momentum": F.col("price_vs_sma50_pct"),
    }


def percentile_score(
    rows: DataFrame, weights: dict[str, float] = SCORE_WEIGHTS, keep: list[str] | None = None
) -> DataFrame:
    """Add ``score``: 100 times the weighted percent ranks of the five components among all rows.

    Of the other columns those in ``keep`` are returned, all without it.  A missing component counts as the lowest.  Each rank goes into the sum and its component is
    dropped; the rows are written after each, as the next rank reads them more than once."""
    parts = score_parts(rows)
    columns = [F.col(c) for c in (rows.columns if keep is None else keep)]
    ranked = rows.select(*columns, *[parts[k].alias(f"_part_{k}") for k in weights], F.lit(0.0).alias("_total"))
    for k, w in weights.items():
        ranked = with_percent_rank(written(ranked, "scored"), f"_part_{k}", "_rank")
        ranked = ranked.withColumn("_total", F.col("_total") + F.coalesce("_rank", F.lit(0.0)) * w)
        ranked = ranked.drop("_rank", f"_part_{k}")
    return ranked.withColumn("score", F.col("_total") * 100).drop("_total")
