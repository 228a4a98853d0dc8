"""The screening chain against a plain reading of its rules, with every field missing once."""

from __future__ import annotations

import itertools
from dataclasses import replace

import pytest

from lowtide.criteria import DEFAULT, PRESETS, apply_preset, version
from lowtide.operators import screen

FIELDS = (
    "price double, low_52w double, high_52w double, usd_mcap double, rvol double, volume bigint, "
    "avg_volume_20d double, days_since_low bigint, rsi double, price_vs_sma50_pct double, "
    "sma50_vs_sma200_pct double, atr_pct double, debt_to_equity double, current_ratio double"
)
NAMES = [part.split()[0] for part in FIELDS.split(", ")]
GOOD = dict(
    price=10.2, low_52w=10.0, high_52w=40.0, usd_mcap=2.0, rvol=3.0, volume=200_000,
    avg_volume_20d=60_000.0, days_since_low=5, rsi=35.0, price_vs_sma50_pct=0.97,
    sma50_vs_sma200_pct=0.95, atr_pct=0.03, debt_to_equity=1.0, current_ratio=1.5,
)


def passes(symbol: str, row: dict, c) -> bool:
    """The rules one after another; None means the field is absent (for rsi: undefined)."""
    value = lambda name, default: default if row[name] is None else row[name]
    price, low, high = value("price", 0), value("low_52w", 0), value("high_52w", 0)
    cap = value("usd_mcap", 0)
    cap = cap * 1e9 if cap < 1000 else cap
    floors = {".NS": 150e6, ".SR": 150e6, ".JO": 150e6}
    volume, rvol, average = value("volume", 0), value("rvol", 0), value("avg_volume_20d", 0)
    rules = [symbol != "" and price > 0]
    if not rules[0]:
        return False
    rules.append(not c.mcap_enabled or cap >= floors.get(symbol[symbol.find("."):], 500e6))
    if low > 0:
        rules.append(price / low <= c.price_52w_low_pct)
        rules.append(c.price_52w_high_pct <= 0 or high <= 0 or price / high <= c.price_52w_high_pct)
    rules.append(volume >= c.min_volume or rvol >= c.min_rvol)
    rules.append(c.max_rvol is None or rvol <= c.max_rvol)
    rules.append(c.min_avg_volume_20d is None or average <= 0 or average >= c.min_avg_volume_20d)
    days = row["days_since_low"]
    if days is not None and (c.min_days_since_low is not None or c.max_days_since_low is not None):
        rules.append((c.min_days_since_low or 1) <= days <= (c.max_days_since_low or 30))
    rules.append(c.min_price is None or price >= c.min_price)
    rules.append(c.max_price is None or price <= c.max_price)
    if c.rsi_enabled:
        rules.append(row["rsi"] is not None and c.rsi_min <= row["rsi"] <= c.rsi_max)
    if c.ma_enabled:
        rules.append(value("price_vs_sma50_pct", 1.0) >= c.price_vs_sma50_pct)
        rules.append(value("sma50_vs_sma200_pct", 1.0) >= c.sma50_vs_sma200_pct)
    if c.atr_enabled:
        rules.append(c.atr_min_pct <= value("atr_pct", 0.05) <= c.atr_max_pct)
    if c.pattern_enabled and c.breakout_enabled and c.volume_confirmation_required:
        base = volume if row["avg_volume_20d"] is None else row["avg_volume_20d"]
        ratio = volume / base if base > 0 else 0
        near = low > 0 and price / low <= c.price_52w_low_pct
        rules.append((near and ratio >= 2.0) or ratio >= c.min_volume_spike_ratio)
    if c.fundamental_enabled:
        rules.append(value("debt_to_equity", 0) <= c.max_debt_to_equity)
        rules.append(value("current_ratio", 2.0) >= c.min_current_ratio)
    return all(rules)


def cases():
    bad = dict(
        price=0.0, low_52w=5.0, high_52w=12.0, usd_mcap=0.1, rvol=25.0, volume=10, avg_volume_20d=10.0,
        days_since_low=90, rsi=80.0, price_vs_sma50_pct=0.5, sma50_vs_sma200_pct=0.5, atr_pct=0.5,
        debt_to_equity=9.0, current_ratio=0.1,
    )
    edge = dict(
        price=10.3, low_52w=0.0, high_52w=20.4, usd_mcap=600e6, rvol=2.0, volume=50_000,
        avg_volume_20d=0.0, days_since_low=30, rsi=20.0, price_vs_sma50_pct=0.95,
        sma50_vs_sma200_pct=0.93, atr_pct=0.015, debt_to_equity=2.0, current_ratio=1.0,
    )
    rows = [dict(GOOD)]
    for name in NAMES:
        rows += [{**GOOD, name: other} for other in (None, bad[name], edge[name])]
    for a, b in itertools.combinations(NAMES, 2):
        rows += [{**GOOD, a: None, b: None}, {**GOOD, a: edge[a], b: None}, {**GOOD, a: edge[a], b: edge[b]}]
    rows.append(dict.fromkeys(NAMES))
    return [(s, r) for r in rows for s in ("A.NS", "B.HK", "C", "")]


@pytest.mark.parametrize(
    "criteria",
    [
        DEFAULT,
        replace(DEFAULT, fundamental_enabled=True),
        replace(DEFAULT, rsi_enabled=False, ma_enabled=False, atr_enabled=False, pattern_enabled=False),
        replace(DEFAULT, max_rvol=None, min_avg_volume_20d=None, min_price=None, max_price=None),
        replace(DEFAULT, price_52w_high_pct=0.0, min_days_since_low=None, volume_confirmation_required=False),
        *[apply_preset(DEFAULT, name) for name in PRESETS],
    ],
)
def test_every_rule_and_every_missing_field(spark, criteria):
    rows = cases()
    data = [(i, s, *[r[n] for n in NAMES]) for i, (s, r) in enumerate(rows)]
    df = spark.createDataFrame(data, f"id bigint, symbol string, {FIELDS}")
    got = {r["id"] for r in screen.screen(df, criteria).select("id").collect()}
    want = {i for i, (s, r) in enumerate(rows) if passes(s, r, criteria)}
    assert got == want


def test_explain_and_funnel_agree_with_the_screen(spark):
    rows = cases()
    data = [(i, s, *[r[n] for n in NAMES]) for i, (s, r) in enumerate(rows)]
    df = spark.createDataFrame(data, f"id bigint, symbol string, {FIELDS}")
    criteria = replace(DEFAULT, fundamental_enabled=True)
    want = {i for i, (s, r) in enumerate(rows) if passes(s, r, criteria)}
    assert {r["id"] for r in screen.explain_screen(df, criteria).filter("passed").collect()} == want
    steps = [r["remaining"] for r in screen.funnel(df, criteria).orderBy("stage_no").collect()]
    assert steps[0] == len(rows) and steps[-1] == len(want)
    assert steps == sorted(steps, reverse=True)


def test_absent_columns_take_their_defaults(spark):
    df = spark.createDataFrame([("A.NS", 5.0, 300_000, 2.0)], "symbol string, price double, volume bigint, usd_mcap double")
    plain = replace(DEFAULT, pattern_enabled=False, rsi_max=50)
    assert screen.screen(df, plain).first()["pct_from_low"] == 0.0
    assert screen.screen(df, replace(plain, rsi_max=49)).isEmpty()  # the default RSI is 50


def test_legacy_exchange_map(spark):
    df = spark.createDataFrame([("A.SR", 1.0, 0.2), ("A.NS", 1.0, 0.2)], "symbol string, price double, usd_mcap double")
    rule = lambda **o: [r["symbol"] for r in df.filter(screen.predicates(df, DEFAULT, **o)["market_cap"]).collect()]
    assert rule() == ["A.SR", "A.NS"]
    assert rule(legacy_exchange_map=True) == ["A.NS"]


def test_volume_spike_and_breakout(spark):
    from pyspark.sql import functions as F

    spike = lambda v, a, t=1.5: spark.range(1).select(screen.volume_spike(F.lit(v), F.lit(a).cast("double"), t).alias("s")).first()["s"]
    assert tuple(spike(100_000, 50_000)) == (True, 2.0, "moderate")
    assert tuple(spike(400, 100)) == (True, 4.0, "extreme")
    assert tuple(spike(250, 100)) == (True, 2.5, "strong")
    assert tuple(spike(100, 100)) == (False, 1.0, "weak")
    assert tuple(spike(100, None)) == (False, 0.0, "insufficient_data")
    out = lambda *v, t=0.98: spark.range(1).select(
        screen.breakout_near_low(*[F.lit(x).cast("double") for x in v], threshold=t).alias("b")
    ).first()["b"]
    assert out(96.5, 95, 80_000, 40_000)["type"] == "not_near_low"
    assert out(96.5, 0, 80_000, 40_000)["type"] == "invalid_data"
    assert out(93, 95, 10, 40_000)["type"] == "insufficient_volume"
    assert out(93, 95, 80_000, 40_000)["type"] == "bullish_breakout_near_low"
    assert out(100, 95, 80_000, 40_000, t=1.2)["type"] == "breakout_confirmation"


def test_first_nonempty_skips_empty_sources(spark):
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "symbol string")
    assert [r[0] for r in screen.first_nonempty([rows(), rows("b"), rows("c")]).collect()] == ["b"]
    assert screen.first_nonempty([rows(), rows()]).isEmpty()


def test_criteria_version_changes_with_any_threshold():
    assert version(DEFAULT) == version(replace(DEFAULT))
    assert version(DEFAULT) != version(replace(DEFAULT, rsi_max=51))
    assert apply_preset(DEFAULT, "unknown") == DEFAULT
