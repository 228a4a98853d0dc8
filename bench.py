"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query is written to the no-op sink, which computes every row without collecting any.
It is run ``$BENCH_RUNS`` times (2 by default) and the best time counts, so that JVM warm-up
is not measured; set it to 1 for cold times.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from lowtide.checks import REGISTRY
from lowtide.criteria import DEFAULT
from lowtide.operators.indicators import feature_panel, latest_per_key, with_history_gate
from lowtide.operators.screen import explain_screen
from lowtide.session import local_session
from lowtide.sources import benchmark_tables as tables

HEADLINE = (
    "daily_bars",
    "feature_panel",
    "rsi14",
    "week52_stats",
    "double_bottom",
    "screen_wide_panel",
    "screen_funnel",
    "screen_presets",
    "priority_score",
    "offline_screen",
    "digest_by_exchange",
    "universe_build",
    "json_coalesce_flatten",
    "merge_guarded",
    "xml_flatten_roundtrip",
    "xml_paths",
    "integrity_report",
    "quality_metrics",
    "stream_latest_quote",
    "stream_daily_bars",
)


def screen_5000_tickers(spark, sf_dir):
    """The default chain over the newest bar of 5,000 tickers (5 copies of every ticker)."""
    bars = tables.bars(spark, sf_dir).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(5))))
    copies = bars.withColumn("ticker", F.concat(F.col("copy").cast("string"), "ticker")).drop("copy")
    panel = with_history_gate(feature_panel(copies), DEFAULT.min_history_days)
    newest = latest_per_key(panel, ["ticker"], ["price_date"]).withColumnRenamed("ticker", "symbol")
    return explain_screen(newest, DEFAULT)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    # session start-up and the first scan are not part of any query
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").write.format("noop").mode("overwrite").save()
    runs = max(int(os.environ.get("BENCH_RUNS", "2")), 1)
    seconds: dict[str, float] = {}
    jobs = {name: REGISTRY[name].run for name in HEADLINE}
    jobs["screen_5000_tickers"] = screen_5000_tickers
    for name, run in jobs.items():
        times = []
        for _ in range(runs):
            started = time.perf_counter()
            run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - started)
        seconds[name] = round(min(times), 3)
    result = {
        "metric": "headline_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "runs": runs,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
