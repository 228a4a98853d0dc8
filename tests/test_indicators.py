"""Indicators against a plain pandas reading of their definitions."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lowtide.operators import indicators as ind

DAY0 = dt.date(2020, 1, 1)


def bars_frame(series: dict[str, list[tuple[float, float, float, float, int]]]) -> pd.DataFrame:
    rows = []
    for ticker, values in series.items():
        for i, (open_, high, low, close, volume) in enumerate(values):
            day = DAY0 + dt.timedelta(days=i + i // 5 * 2)  # gaps like weekends
            rows.append((ticker, day, open_, high, low, close, volume))
    columns = ["ticker", "price_date", "open", "high", "low", "close", "volume"]
    return pd.DataFrame(rows, columns=columns)


SCHEMA = "ticker string, price_date date, open double, high double, low double, close double, volume bigint"


def expected_row(history: pd.DataFrame, year: int) -> dict:
    """Features as of the last row of one ticker's history."""
    n, last = len(history), history.iloc[-1]
    close, volume = history["close"], history["volume"]
    window = history.tail(year)
    low = window["low"].min()
    low_day = window.loc[window["low"].idxmin(), "price_date"]
    mean = lambda k: close.tail(k).mean() if n >= k else last["close"]
    average30 = volume.tail(30).mean()
    out = {
        "low_52w": low,
        "high_52w": window["high"].max(),
        "days_since_low": (last["price_date"] - low_day).days,
        "rvol": last["volume"] / average30 if average30 > 0 else 0.0,
        "avg_volume_20d": volume.tail(20).mean() if n >= 20 else float(last["volume"]),
        "sma50": mean(50),
        "sma200": mean(200),
        "price_vs_sma50_pct": last["close"] / mean(50),
        "sma50_vs_sma200_pct": mean(50) / mean(200),
    }
    if n < 15:
        out.update(rsi=50.0, atr_pct=0.05)
    else:
        moves = close.diff().tail(14)
        up, down = moves.clip(lower=0).sum(), -moves.clip(upper=0).sum()
        flat = abs(up) < 1e-12 and abs(down) < 1e-12
        out["rsi"] = None if flat else 100 * up / (up + down)
        before = close.shift(1)
        ranges = pd.concat(
            [history["high"] - history["low"], (history["high"] - before).abs(), (history["low"] - before).abs()],
            axis=1,
        ).max(axis=1)
        out["atr_pct"] = ranges.tail(14).mean() / last["close"]
    return out


def double_bottom_of(closes: list[float]) -> bool:
    if len(closes) < 20:
        return False
    last = closes[-20:]
    bottoms = sorted(b for a, b, c in zip(last, last[1:], last[2:]) if b < a and b < c)
    if len(bottoms) < 2:
        return False
    first, second = bottoms[:2]
    return (second - first) / first <= 0.05 and last[-1] > (first + second) / 2


def check(spark, frame: pd.DataFrame, year: int = 252) -> None:
    panel = ind.feature_panel(spark.createDataFrame(frame, SCHEMA), year_rows=year, patterns=True)
    got = panel.toPandas().sort_values(["ticker", "price_date"])
    for ticker, rows in got.groupby("ticker"):
        history = frame[frame["ticker"] == ticker].reset_index(drop=True)
        assert list(rows["n_bars"]) == list(range(1, len(history) + 1))
        for i, row in enumerate(rows.to_dict("records")):
            want = expected_row(history.head(i + 1), year)
            for name, value in want.items():
                actual = row[name]
                if value is None:
                    assert actual is None or math.isnan(actual), (ticker, i, name, actual)
                else:
                    assert actual == pytest.approx(value, rel=1e-9, abs=1e-9), (ticker, i, name)
            closes = list(history["close"].head(i + 1))
            assert row["double_bottom"] == double_bottom_of(closes), (ticker, i)


def candles(closes, volumes=None):
    return [
        (c, round(c + 1.25, 2), round(max(c - 0.75, 0.01), 2), c, v)
        for c, v in zip(closes, volumes or [1000 + 10 * i for i in range(len(closes))])
    ]


def test_shapes(spark):
    rng = np.random.default_rng(7)
    walk = [round(float(x), 2) for x in 100 + np.cumsum(rng.normal(0, 2, 330))]
    series = {
        "WALK": candles(walk),
        "SHORT": candles([10.0, 11.0, 10.5]),
        "FLAT": candles([25.0] * 40, [0] * 40),
        "UP": candles([float(i + 5) for i in range(60)]),
        "DOWN": candles([float(200 - i) for i in range(60)]),
        "TIES": candles([50.0, 40.0, 50.0, 40.0, 50.0] * 12),
    }
    check(spark, bars_frame(series))


@pytest.mark.parametrize("year", [1, 2, 5, 16, 17, 30])
def test_extremes_over_any_number_of_rows(spark, year):
    rng = np.random.default_rng(year)
    series = {"A": candles([round(float(x), 2) for x in rng.uniform(5, 50, 70)])}
    check(spark, bars_frame(series), year=year)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(100, 4000), min_size=1, max_size=60), st.integers(0, 5))
def test_random_series(spark, cents, spread):
    rows = [(c / 100, (c + spread) / 100, (c - spread) / 100, c / 100, c * 7) for c in cents]
    check(spark, bars_frame({"R": rows}), year=20)


def test_lows_five_percent_apart_are_a_double_bottom(spark):
    # as doubles (1.05 - 1.0) / 1.0 is a little more than 0.05
    closes = [2.0] * 8 + [1.0] + [2.0] * 5 + [1.05] + [2.0] * 5
    flags = ind.with_double_bottom(spark.createDataFrame(bars_frame({"P": candles(closes)}), SCHEMA))
    assert ind.latest_per_key(flags, ["ticker"], ["price_date"]).first()["double_bottom"] is True
    assert "_close" not in flags.columns


def test_stepwise_series_is_no_double_bottom(spark):
    closes = [100.0] * 10 + [95.0] * 5 + [98.0] * 5 + [94.0] * 5 + [97.0] * 5 + [96.0] * 5 + [102.0] * 5 + [105.0] * 10
    frame = bars_frame({"P": candles(closes)})
    flags = ind.with_double_bottom(spark.createDataFrame(frame, SCHEMA))
    last = ind.latest_per_key(flags, ["ticker"], ["price_date"]).first()
    assert last["double_bottom"] is False


def test_missing_high_and_low_are_skipped(spark):
    rows = [
        ("A", DAY0 + dt.timedelta(days=i), 10.0, None if i == 2 else 12.0 + i, None if i == 0 else 9.0 + i, 10.0, 5)
        for i in range(5)
    ]
    panel = ind.feature_panel(spark.createDataFrame(rows, SCHEMA)).orderBy("price_date").collect()
    assert [r["low_52w"] for r in panel] == [None, 10.0, 10.0, 10.0, 10.0]
    assert [r["high_52w"] for r in panel] == [12.0, 13.0, 13.0, 15.0, 16.0]
    assert panel[-1]["days_since_low"] == 3


def test_fixed_divisor(spark):
    frame = bars_frame({"A": candles([10.0] * 10, [300] * 10)})
    panel = ind.feature_panel(spark.createDataFrame(frame, SCHEMA), fixed_rvol_divisor=True)
    last = ind.latest_per_key(panel, ["ticker"], ["price_date"]).first()
    assert last["rvol"] == pytest.approx(300 / (3000 / 30))


# --- the panel carried forward ------------------------------------------------------------------

FEATURES = ["ticker", "price_date", "n_bars", "price", "volume", "low_52w", "high_52w", "low_date", "days_since_low", "avg_volume_30d", "rvol"]
FEATURES += ["avg_volume_20d", "rsi", "sma50", "sma200", "price_vs_sma50_pct", "sma50_vs_sma200_pct", "atr_pct"]


def gappy_bars(days, seed=11):
    """Tickers that begin late, pause, stay flat, and lack highs, lows or volumes."""
    r, rows = np.random.default_rng(seed), []
    for t, (first, pause) in {"A": (0, None), "B": (days - 9, None), "C": (3, range(days - 6, days - 3)), "FLAT": (0, None)}.items():
        close = 50.0
        for d in range(first, days):
            if pause and d in pause:
                continue
            close = 10.0 if t == "FLAT" else round(max(1.0, close + r.normal()), 2)
            high, low = close + 1, close - 0.5
            rows.append((t, DAY0 + dt.timedelta(days=d), close, None if d % 17 == 5 else high, None if d % 13 == 4 else low, close, None if d % 19 == 3 else int(r.integers(0, 9999))))
    return rows


def test_day_by_day_equals_the_whole_panel(spark):
    from lowtide.operators import incremental
    from lowtide.session import run_folder

    days, new = 290, 8
    rows = gappy_bars(days)
    bars = spark.createDataFrame(rows, SCHEMA)
    path, last = run_folder(spark, "panel"), DAY0 + dt.timedelta(days=days - 1)
    cut = last - dt.timedelta(days=new)
    history = spark.createDataFrame([x for x in rows if x[1] <= cut], SCHEMA)
    incremental.start(history, ind.feature_panel(history), path, cut)
    before = cut
    for i in range(new):
        day = cut + dt.timedelta(days=i + 1)
        incremental.append_bars(spark.createDataFrame([x for x in rows if x[1] == day], SCHEMA), path)
        incremental.run_day(spark, path, before, day)
        if i == 2:  # a day that runs again gives the same
            incremental.run_day(spark, path, before, day)
        before = day
    want = sorted(map(repr, ind.feature_panel(bars).select(*FEATURES).collect()))
    assert sorted(map(repr, incremental.read_features(spark, path).select(*FEATURES).collect())) == want


def test_a_new_day_reads_one_partition_of_bars_and_one_of_state(spark):
    from lowtide.operators import incremental
    from lowtide.session import run_folder

    rows = gappy_bars(40)
    path = run_folder(spark, "panel")
    days = sorted({x[1] for x in rows})
    bars = spark.createDataFrame(rows, SCHEMA)
    for day in days[-3:]:
        incremental.append_bars(bars.filter(F.col("price_date") == F.lit(day)), path)
    history = bars.filter(F.col("price_date") <= F.lit(days[-4]))
    incremental.start(history, ind.feature_panel(history), path, days[-4])
    incremental.run_day(spark, path, days[-4], days[-3])
    step = incremental.next_state(spark, path, days[-3], days[-2])
    text = step._jdf.queryExecution().explainString(step.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert text.count("Scan parquet") >= 2 and "Window" not in text
    for column, day in (("price_date", days[-2]), ("run_date", days[-3])):
        assert f"({column}#" in text and f"= {day})" in text and "PartitionFilters" in text
    files = {f.split("/")[-2] for f in step.inputFiles()}
    assert files == {f"price_date={days[-2]}", f"run_date={days[-3]}"} or step.inputFiles()


def test_state_from_nothing(spark):
    from lowtide.operators import incremental

    rows = gappy_bars(6)
    first = spark.createDataFrame([x for x in rows if x[1] == DAY0], SCHEMA)
    state = incremental.advance(incremental.state_of(first.limit(0)), first)
    assert sorted(map(repr, incremental.features_of(state).select(*FEATURES).collect())) == sorted(map(repr, ind.feature_panel(first).select(*FEATURES).collect()))
