"""Physical plans: shuffles, broadcasts, pushed filters, and hot keys."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lowtide import dims, schemas
from lowtide.criteria import DEFAULT, apply_preset
from lowtide.operators import indicators, lookups, merge, reports, screen, universe
from lowtide.operators.bars import daily_bars, market_summary
from lowtide.session import run_folder

DAY = dt.date(2026, 1, 1)


def plan(df) -> str:
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def tree(df) -> str:
    return plan(df).split("\n\n")[0]


@pytest.fixture(scope="module")
def bars(spark):
    path = run_folder(spark, "bars")
    (
        spark.range(0, 4000)
        .select(
            F.when(F.col("id") % 3 == 0, "HOT.NS").otherwise(F.concat(F.lit("T"), (F.col("id") % 50).cast("string"))).alias("ticker"),
            F.date_add(F.lit(DAY), F.floor(F.col("id") / 3).cast("int")).alias("price_date"),
            *[(F.col("id") % 37 + 5.0).alias(c) for c in ("open", "high", "low", "close")],
            (F.col("id") * 10).alias("volume"),
        )
        .dropDuplicates(["ticker", "price_date"])
        .write.parquet(path)
    )
    return spark.read.parquet(path)


def test_all_indicators_share_one_shuffle_and_one_sort(bars):
    text = tree(indicators.feature_panel(bars, patterns=True))
    assert text.count("Exchange") == 1 and text.count("Sort (") == 1
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_unused_indicators_and_columns_are_pruned(bars):
    df = indicators.feature_panel(bars).select("ticker", "price_date", "rsi")
    assert "ReadSchema: struct<ticker:string,price_date:date,close:double>" in plan(df)
    assert tree(df).count("Window") < tree(indicators.feature_panel(bars)).count("Window") + 1


def test_screen_adds_no_shuffle(bars):
    rows = indicators.feature_panel(bars).withColumnRenamed("ticker", "symbol")
    assert tree(screen.screen(rows, DEFAULT)).count("Exchange") == 1
    scored = screen.priority_score(screen.screen(rows, apply_preset(DEFAULT, "wide")), DEFAULT)
    assert tree(scored).count("Exchange") == 1
    assert "TakeOrderedAndProject" in tree(screen.top_scored(scored, 5, ["symbol"]))


def test_one_aggregate_gives_quote_and_year(bars):
    text = tree(market_summary(bars, DAY))
    assert text.count("Scan parquet") == 1 and text.count("Exchange") == 1


def test_fallback_is_one_lazy_plan(spark, bars):
    rows = indicators.feature_panel(bars).withColumnRenamed("ticker", "symbol")
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    before = jobs()
    pick = lambda name: screen.screen(rows, apply_preset(DEFAULT, name)).select("symbol", F.lit(name).alias("source"))
    found = screen.first_nonempty([pick("conservative"), pick("wide"), pick("aggressive")])
    assert jobs() == before  # nothing runs while the plan is built
    assert found.select("source").distinct().count() <= 1


def test_universe_reads_each_table_twice_at_most(spark):
    path = run_folder(spark, "universe")
    spark.createDataFrame([("A.NS", "NSE", "ACTIVE", None, None)], schemas.TICKERS).write.parquet(f"{path}/t")
    listed = "ticker string, exchange string, market string, market_cap_category string"
    spark.createDataFrame([("B", "NSE", "NSE", "Large Cap")], listed).write.parquet(f"{path}/d")
    found = universe.build_universe(spark, spark.read.parquet(f"{path}/t"), spark.read.parquet(f"{path}/d"), dims.MARKET_FLAGS, DAY)
    text = plan(found)
    assert text.count(f"{path}/t]") <= 2 and text.count(f"{path}/d]") <= 1


def test_preset_comparison_reads_the_features_once(bars):
    rows = indicators.feature_panel(bars).withColumnRenamed("ticker", "symbol")
    assert tree(screen.compare_presets(rows, DEFAULT, ["balanced", "aggressive"])).count("Scan parquet") == 1
    assert tree(screen.funnel(rows, DEFAULT)).count("Scan parquet") == 1


def test_date_filters_reach_the_scan(bars):
    pushed = plan(universe.prices_between(bars, "2026-02-01", "2026-03-01"))
    assert "PushedFilters: [IsNotNull(price_date), GreaterThanOrEqual(price_date,2026-02-01)" in pushed


def test_dimensions_are_broadcast_and_nothing_else_by_hint(spark, bars):
    for df in (
        lookups.with_exchange(bars, spark),
        lookups.with_market(bars.withColumn("exchange", F.upper("ticker")), spark),
        lookups.with_fx(bars.withColumn("currency", F.upper("ticker")), dims.fx_rates(spark), "close"),
    ):
        assert "BroadcastHashJoin" in tree(df) and "Exchange hashpartitioning" not in plan(df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        other = bars.select("ticker").limit(10)
        for df in (lookups.missing_from(bars, other), lookups.present_in(bars, other), lookups.not_in(bars, other)):
            assert "SortMergeJoin" in tree(df) and "Broadcast" not in tree(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_aggregates_combine_before_the_shuffle(spark, bars):
    quotes = bars.withColumn("last_updated", F.col("price_date").cast("timestamp_ntz"))
    for df in (
        indicators.latest_per_key(quotes, ["ticker"], ["last_updated"]),
        merge.guarded_upsert(quotes, quotes, ["ticker"], "last_updated"),
        daily_bars(bars.select("ticker", "price_date", "close", "volume"), ["ticker"], "close", F.col("volume"), ["volume"]),
        lookups.orphan_count(bars, bars.limit(1)),
    ):
        assert "partial_" in plan(df)


def test_rank_limit_is_applied_before_the_shuffle(bars):
    text = tree(reports.top_per_category(bars, "ticker", ["price_date", "volume"], 3, 5))
    assert text.index("Exchange") > text.index("WindowGroupLimit")  # printed top-down
    assert text.count("WindowGroupLimit") == 2


def test_daily_bars_of_a_hot_ticker_stay_bounded(spark):
    """A ticker with most trades still has one bar per day, so its window partition is small."""
    trades = spark.range(0, 60_000).select(
        F.when(F.col("id") % 3 < 2, "HOT").otherwise(F.concat(F.lit("T"), F.col("id").cast("string"))).alias("ticker"),
        F.date_add(F.lit(DAY), (F.col("id") % 400).cast("int")).alias("price_date"),
        (F.col("id") % 97 + 1).cast("double").alias("price"),
        F.col("id").alias("seq"),
    )
    bars = daily_bars(trades, ["ticker"], "price", F.lit(1), ["seq"])
    hot = bars.filter("ticker = 'HOT'")
    assert hot.count() == 400
    assert hot.agg(F.sum("volume")).first()[0] == 40_000
    last = indicators.latest_per_key(indicators.feature_panel(bars), ["ticker"], ["price_date"])
    row = last.filter("ticker = 'HOT'").first()
    assert row["n_bars"] == 400 and row["low_52w"] == 1.0


def test_hot_lookup_side_ships_one_row_per_task(spark):
    """A third of all raw rows belong to one ticker; the anti join sees it once per task."""
    raw = spark.range(0, 30_000).select(
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("T"), (F.col("id") % 1000).cast("string"))).alias("ticker")
    )
    tickers = spark.createDataFrame([("HOT",), ("T1",), ("NEW",)], "ticker string")
    assert [r["ticker"] for r in lookups.missing_from(tickers, raw).collect()] == ["NEW"]
    assert "HashAggregate" in tree(lookups.missing_from(tickers, raw))
