"""Numbers in display strings are rounded as the SQL twins round them."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from lowtide.functions import text

# the first five lie a little below a half, which their tenfold is
VALUES = [
    0.44999999999999996, 1.8499999999999999, 3.3499999999999996, 3.4499999999999997, 3.9499999999999997,
    0.49999999999999994, 0.25, 2.5, 0.0, 1.05, 12.349999999999998, 1e17, 83.0,
]


def test_rounding_of_texts(spark):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(VALUES)], "i int, x double")
    for digits in (0, 1, 2):
        got = rows.orderBy("i").select(text.fixed(F.col("x"), digits).alias("t")).collect()
        want = [duckdb.execute(f"SELECT format('{{:.{digits}f}}', round(CAST({v!r} AS DOUBLE), {digits}))").fetchone()[0] for v in VALUES]
        assert [r["t"] for r in got] == want
    odd = [(-0.04,), (-0.25,), (float("nan"),)]
    got = spark.createDataFrame(odd, "x double").select(text.fixed(F.col("x"), 1).alias("t")).collect()
    assert [r["t"] for r in got] == ["0.0", "-0.3", "NaN"]
