"""Steps that several branches of a plan read are worked out once."""

from __future__ import annotations

from pathlib import Path

from compare import connect, difference, spark_rows, sql_rows

from lowtide.checks import REGISTRY
from lowtide.operators import ranks
from lowtide.sources import tables as readers

SF_DIR = str(Path("/root/testdata/sf0.001"))


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_reads_of_ranked_rows_do_not_double_with_each_component(spark):
    rows = spark.range(50).selectExpr(
        "id", "id * 1.5D AS rvol", "id % 7 * 1D AS pct_from_low", "id * 3 AS volume", "id % 11 * 1D AS rsi", "1D AS price_vs_sma50_pct"
    )
    scored = ranks.percentile_score(rows, keep=["id"])
    assert scored.columns == ["id", "score"] and scored.count() == 50
    assert plan(scored).count("Relation") <= 8
    assert sorted(ranks.percentile_score(rows).select("id", "score").collect()) == sorted(scored.collect())


def test_a_line_of_a_catch_log_is_cut_once(spark, tmp_path):
    for name, header, line in (("a", "ticker,price,volume,reason", 'A,1.5,3,"x, y"'), ("b", "volume,reason,price,ticker", "about 4,ticker price,2,B")):
        (tmp_path / f"{name}.csv").write_text(f"{header}\n{line}\n")
    kept, bad = readers.read_catches(spark, str(tmp_path)), readers.malformed_catches(spark, str(tmp_path))
    assert [tuple(r) for r in kept.select("ticker", "price", "volume", "reason").collect()] == [("A", 1.5, 3, "x, y")]
    assert [(r["issue"], r["fields"]["ticker"], r["fields"]["reason"]) for r in bad.collect()] == [("volume", "B", "ticker price")]
    # once for the lines, once for the few that may be headers
    assert plan(bad).count("regexp_extract_all") <= 2
    assert plan(bad).count("map_from_arrays") == 1


def test_the_fallback_chain_has_its_features_written(spark):
    query = REGISTRY["fallback_chain"]
    found = query.run(spark, SF_DIR)
    assert "Window" not in plan(found)
    assert difference(spark_rows(found), sql_rows(connect(SF_DIR), query.sql)) is None
