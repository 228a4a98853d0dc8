"""Outlier limits learned from the data: mergeable sketches first, then an exact second pass.

A KLL sketch of each column and group (one aggregate, a few kilobytes a group and task) gives a value
a little below and one a little above each quartile.  The second pass counts what lies below that bracket and
ranks only the values inside it, so the quartiles, the limits and the counts are exact, and what
is sorted is a small share of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lowtide.operators.ranks import running_counts
from lowtide.session import written

#: size of a sketch, and the rank on both sides of a quartile that its error (0.4 %) stays within
SKETCH, MARGIN = 800, 0.02
QUARTILES = {"q1": 0.25, "q3": 0.75}
FENCE = 1.5


def long_form(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """``key`` (group_value and column_name) and ``value`` of every number that is there.

    Structs are equal with equal fields, NULL ones included, so rows without a group are a group."""
    values = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns])
    found = rows.select(F.col(group).cast("string").alias("group_value"), F.inline(values))
    found = found.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    return found.select(F.struct("group_value", "column_name").alias("key"), "value")


def sketches(values: DataFrame) -> DataFrame:
    """One sketch and count a key; sketches of parts or days can be merged (``kll_merge_agg_double``)."""
    return values.groupBy("key").agg(F.kll_sketch_agg_double("value", SKETCH).alias("sketch"), F.count("*").alias("rows"))


def brackets(known: DataFrame) -> DataFrame:
    """Per key and quartile: its place among the sorted rows, and two values around it."""
    at = lambda rank: F.kll_sketch_get_quantile_double("sketch", F.lit(rank))
    parts = [
        F.struct(
            F.lit(name).alias("quartile"),
            F.greatest(F.ceil(F.col("rows") * share), F.lit(1)).alias("place"),
            at(max(share - MARGIN, 0.0)).alias("low"),
            at(min(share + MARGIN, 1.0)).alias("high"),
        )
        for name, share in QUARTILES.items()
    ]
    return known.select("key", "rows", F.inline(F.array(*parts)))


def quartiles(values: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``key, rows, q1, q3``: the exact quartiles (the smallest value that a quarter, or three, of the rows do
    not exceed).  ``known`` are the sketches of the same values if they are stored."""
    around = written(brackets(written(sketches(values) if known is None else known, "sketches")), "brackets")
    inside = F.col("value") >= F.col("low")
    met = values.join(around.select("key", "quartile", "low", "high"), "key").filter(F.col("value") <= F.col("high"))
    # distinct values inside the bracket, and one row for all that lies below it
    counted = met.groupBy("key", "quartile", F.when(inside, F.col("value")).alias("value")).agg(F.count("*").alias("n"))
    counted = written(counted, "counted")
    under = counted.filter("value IS NULL").select("key", "quartile", F.col("n").alias("under"))
    ranked = running_counts(counted.filter("value IS NOT NULL"), ["key", "quartile"], "value")
    hit = ranked.join(around.select("key", "quartile", "rows", "place"), ["key", "quartile"]).join(under, ["key", "quartile"], "left")
    smaller = F.coalesce("under", F.lit(0)) + F.col("below")
    hit = hit.filter((smaller < F.col("place")) & (smaller + F.col("n") >= F.col("place")))
    picked = [F.max(F.when(F.col("quartile") == name, F.col("value"))).alias(name) for name in QUARTILES]
    return hit.groupBy("key").agg(F.max("rows").alias("rows"), *picked)


def outliers(rows: DataFrame, group: str, columns: list[str], fence: float = FENCE) -> DataFrame:
    """Per group and column: rows, quartiles, limits (``fence`` interquartile ranges off) and the rows beyond them."""
    values = written(long_form(rows, group, columns), "values")
    spread = F.col("q3") - F.col("q1")
    limits = quartiles(values).withColumns({"low_limit": F.col("q1") - spread * fence, "high_limit": F.col("q3") + spread * fence})
    limits = written(limits, "limits")
    beyond = (F.col("value") < F.col("low_limit")) | (F.col("value") > F.col("high_limit"))
    counts = values.join(limits.select("key", "low_limit", "high_limit"), "key").groupBy("key").agg(F.count_if(beyond).alias("outliers"))
    return limits.join(counts, "key").select("key.*", "rows", "q1", "q3", "low_limit", "high_limit", "outliers")
