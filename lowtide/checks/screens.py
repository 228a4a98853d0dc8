"""Screening predicates, chains, funnels, presets, scores."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from lowtide import dims
from lowtide.checks.base import query, sql
from lowtide.checks.indicators import panel
from lowtide.criteria import DEFAULT, ENHANCED, ENHANCED_PRESETS, apply_preset
from lowtide.operators import indicators as ind
from lowtide.operators import lookups, ranks, screen
from lowtide.operators.bars import current_quotes, market_summary
from lowtide.session import written
from lowtide.sources import benchmark_tables as tables
from lowtide.sources import json_docs, xml_docs
from lowtide.sources.benchmark_tables import LAST_DAY

WIDE = apply_preset(DEFAULT, "wide")

# conditions of the loose preset, in screening order, over SQL panel rows
WIDE_STAGES = {
    "required": "price > 0",
    "near_low": "(NOT low_52w > 0 OR price / low_52w <= 1e1)",
    "below_high": "(NOT low_52w > 0 OR NOT high_52w > 0 OR price / high_52w <= 5e-1)",
    "liquid": "(volume >= 50000 OR rvol >= 2e0)",
    "rvol_cap": "rvol <= 2e1",
    "min_price": "price >= 1e0",
    "max_price": "price <= 1e3",
    "rsi": "coalesce(rsi BETWEEN 20 AND 50, FALSE)",
}
WIDE_SQL = " AND ".join(WIDE_STAGES.values())


def features(spark, sf, gated=True, **options):
    """Panel rows in the form the screens read, joined with nothing else."""
    rows = panel(spark, sf, **options)
    if gated:
        rows = ind.with_history_gate(rows, DEFAULT.min_history_days)
    return rows.withColumnRenamed("ticker", "symbol")


def capped_features(spark, sf):
    """Panel rows with fundamentals: cap in billions, ratios."""
    known = tables.fundamentals(spark, sf).select(
        F.col("ticker").alias("symbol"),
        (F.col("mkt_cap_usd") / 1e9).alias("usd_mcap"),
        "debt_to_equity",
        "current_ratio",
    )
    return features(spark, sf).join(known, "symbol", "left")


CAPPED = """capped AS (
    SELECT p.*, f.mkt_cap_usd / 1e9 AS usd_mcap, f.debt_to_equity, f.current_ratio,
           coalesce(reg.min_cap_usd, 500000000) AS floor
    FROM panel p LEFT JOIN fundamentals f USING (ticker)
    LEFT JOIN reg ON reg.suffix = '.' || split_part(p.ticker, '.', 2) AND p.ticker LIKE '%.%'
    WHERE p.n_bars > 250)"""

# every default condition, written against ``capped``
STAGES = {
    "required": "price > 0",
    "market_cap": "coalesce(CASE WHEN coalesce(usd_mcap, 0e0) < 1000 THEN coalesce(usd_mcap, 0e0) * 1e9"
    " ELSE usd_mcap END, 0e0) >= floor",
    "near_low": "(NOT low_52w > 0 OR price / low_52w <= 1.03e0)",
    "below_high": "(NOT low_52w > 0 OR NOT high_52w > 0 OR price / high_52w <= 5e-1)",
    "liquid": "(volume >= 50000 OR rvol >= 2e0)",
    "rvol_cap": "rvol <= 2e1",
    "avg_volume": "(NOT avg_volume_20d > 0 OR avg_volume_20d >= 50000)",
    "low_age": "days_since_low BETWEEN 1 AND 30",
    "min_price": "price >= 1e0",
    "max_price": "price <= 1e3",
    "rsi": "coalesce(rsi BETWEEN 20 AND 50, FALSE)",
    "ma_support": "(price_vs_sma50_pct >= 0.95e0 AND sma50_vs_sma200_pct >= 0.93e0)",
    "atr": "atr_pct BETWEEN 0.015e0 AND 0.08e0",
    "pattern": "(avg_volume_20d > 0 AND volume / avg_volume_20d >= 2e0)",
}


@query(
    "screen_wide_panel",
    "C-17 C-1 C-3 C-4 C-5 C-6 C-9 C-10",
    sql(
        "panel",
        f"""SELECT ticker AS symbol, price_date, price, low_52w, high_52w, volume,
                   round(rvol, 6) AS rvol, round(rsi, 6) AS rsi,
                   round(CASE WHEN low_52w > 0 THEN price / low_52w ELSE 0e0 END, 6) AS pct_from_low
            FROM panel WHERE n_bars > 250 AND {WIDE_SQL}""",
    ),
)
def screen_wide_panel(spark, sf):
    return screen.screen(features(spark, sf), WIDE).select(
        "symbol", "price_date", "price", "low_52w", "high_52w", "volume",
        F.round("rvol", 6).alias("rvol"),
        F.round("rsi", 6).alias("rsi"),
        F.round("pct_from_low", 6).alias("pct_from_low"),
    )


def _funnel_sql(stages: dict[str, str], source: str) -> str:
    names = list(stages)
    rows = [f"SELECT 0 AS stage_no, 'input' AS stage, count(*) AS remaining FROM {source}"]
    for i, name in enumerate(names, start=1):
        kept = " AND ".join(stages[n] for n in names[:i])
        rows.append(f"SELECT {i}, '{name}', count(*) FILTER ({kept}) FROM {source}")
    return "\nUNION ALL ".join(rows)


@query("screen_funnel", "C-25 C-2 C-7 C-8 C-11 C-12", sql("panel fundamentals", _funnel_sql(STAGES, "capped"), CAPPED))
def screen_funnel(spark, sf):
    return screen.funnel(capped_features(spark, sf), DEFAULT)


@query(
    "screen_explain",
    "C-27 C-1 C-2 C-3 C-4 C-5 C-6 C-7 C-8 C-9 C-10 C-11 C-12",
    sql(
        "panel fundamentals",
        "SELECT ticker AS symbol, price_date, "
        + ", ".join(f"{c} AS ok_{n}" for n, c in STAGES.items())
        + ", "
        + " AND ".join(STAGES.values())
        + " AS passed FROM capped",
        CAPPED,
    ),
)
def screen_explain(spark, sf):
    rows = capped_features(spark, sf)
    judged = screen.explain_screen(rows, DEFAULT)
    return judged.select(
        "symbol", "price_date", *[c for c in judged.columns if c.startswith("ok_")], "passed"
    )


LOOSE_FUNDAMENTAL = replace(WIDE, fundamental_enabled=True, mcap_enabled=True)


@query(
    "screen_fundamental",
    "C-15 C-2",
    sql(
        "panel fundamentals",
        f"""SELECT ticker AS symbol, price_date, price, debt_to_equity, current_ratio FROM capped
            WHERE {WIDE_SQL} AND {STAGES['market_cap']}
              AND coalesce(debt_to_equity, 0e0) <= 2 AND coalesce(current_ratio, 2e0) >= 1""",
        CAPPED,
    ),
)
def screen_fundamental(spark, sf):
    return screen.screen(capped_features(spark, sf), LOOSE_FUNDAMENTAL).select(
        "symbol", "price_date", "price", "debt_to_equity", "current_ratio"
    )


def _preset_sql(name: str, low: str, rvol: str, rsi_max: str, adv: str) -> str:
    return f"""SELECT '{name}' AS preset, ticker FROM panel WHERE n_bars > 250 AND price > 0
        AND price / low_52w <= {low} AND price / high_52w <= 5e-1
        AND (volume >= 50000 OR rvol >= {rvol}) AND rvol <= 2e1
        AND avg_volume_20d >= {adv} AND price BETWEEN 1e0 AND 1e3
        AND coalesce(rsi BETWEEN 20 AND {rsi_max}, FALSE)"""


# the presets overlaid on criteria whose volatile-market limits are off
PRESET_BASE = replace(
    DEFAULT,
    price_52w_low_pct=10.0,
    mcap_enabled=False,
    ma_enabled=False,
    atr_enabled=False,
    pattern_enabled=False,
    min_days_since_low=None,
    max_days_since_low=None,
    min_avg_volume_20d=10_000,
)


@query(
    "screen_presets",
    "C-26 F-28",
    sql(
        "panel",
        "SELECT preset, count(ticker) AS passing_rows, count(DISTINCT ticker) AS passing_symbols\n"
        "FROM (VALUES ('conservative'), ('aggressive'), ('balanced')) p(preset) LEFT JOIN (\n"
        + "\nUNION ALL ".join(
            [
                _preset_sql("conservative", "1.03e0", "3e0", "30", "100000"),
                _preset_sql("aggressive", "1.05e0", "1.5e0", "50", "25000"),
                _preset_sql("balanced", "1e1", "2e0", "50", "10000"),
            ]
        )
        + ") USING (preset) GROUP BY preset",
    ),
)
def screen_presets(spark, sf):
    return screen.compare_presets(
        features(spark, sf), PRESET_BASE, ["conservative", "aggressive", "balanced"]
    )


@query(
    "screen_presets_enhanced",
    "C-26 F-28",
    sql(
        "panel",
        "SELECT preset, count(ticker) AS passing_rows, count(DISTINCT ticker) AS passing_symbols\n"
        "FROM (VALUES ('conservative'), ('aggressive'), ('balanced')) p(preset) LEFT JOIN (\n"
        + "\nUNION ALL ".join(
            f"""SELECT '{name}' AS preset, ticker FROM panel WHERE n_bars > 250 AND price > 0
                AND (NOT low_52w > 0 OR price / low_52w <= {low})
                AND (NOT low_52w > 0 OR NOT high_52w > 0 OR price / high_52w <= 5e-1)
                AND (volume >= 100000 OR rvol >= {rvol}) AND rvol <= 2e1 AND price BETWEEN 1e0 AND 1e3
                AND (NOT avg_volume_20d > 0 OR avg_volume_20d >= {average})
                AND coalesce(rsi BETWEEN 20 AND {rsi}, FALSE)"""
            for name, low, rvol, rsi, average in (
                ("conservative", "1.005e0", "3e0", 30, 100000),
                ("aggressive", "1.05e0", "1.5e0", 50, 25000),
                ("balanced", "1.01e0", "2e0", 40, 50000),
            )
        )
        + ") USING (preset) GROUP BY preset",
    ),
)
def screen_presets_enhanced(spark, sf):
    """The second profile and its own presets; what synthetic bars cannot meet is off."""
    base = replace(
        ENHANCED, mcap_enabled=False, ma_enabled=False, atr_enabled=False,
        min_days_since_low=None, max_days_since_low=None,
    )
    return screen.compare_presets(
        features(spark, sf), base, ["conservative", "aggressive", "balanced"], ENHANCED_PRESETS
    )


@query(
    "screen_rows_by_preset",
    "C-26",
    sql(
        "panel",
        f"""SELECT 'wide' AS preset, ticker AS symbol, price_date FROM panel
            WHERE n_bars > 250 AND {WIDE_SQL}
            UNION ALL
            {_preset_sql("balanced", "1e1", "2e0", "50", "10000")
             .replace("ticker FROM", "ticker AS symbol, price_date FROM")}""",
    ),
)
def screen_rows_by_preset(spark, sf):
    rows = features(spark, sf)
    base = replace(PRESET_BASE, price_52w_low_pct=10.0)
    return screen.screen_with_presets(rows, base, ["wide", "balanced"]).select(
        "preset", "symbol", "price_date"
    )


@query(
    "volume_spike",
    "C-13",
    sql(
        "panel",
        """SELECT ticker, price_date, ratio >= 1.5e0 AS confirmed, round(ratio, 1) AS ratio,
             CASE WHEN ratio >= 4e0 THEN 'extreme' WHEN ratio >= 2.5e0 THEN 'strong'
                  WHEN ratio >= 1.5e0 THEN 'moderate' ELSE 'weak' END AS strength
           FROM (SELECT *, volume / avg_volume_20d AS ratio FROM panel)""",
    ),
)
def volume_spike(spark, sf):
    spike = screen.volume_spike(F.col("volume"), F.col("avg_volume_20d"))
    return panel(spark, sf).select("ticker", "price_date", spike.alias("s")).select(
        "ticker", "price_date", "s.*"
    )


@query(
    "breakout_type",
    "C-14",
    sql(
        "panel",
        """SELECT ticker, price_date, pct <= 1.5e0 AND ratio >= 2e0 AS detected,
             CASE WHEN NOT low_52w > 0 THEN 'invalid_data' WHEN pct > 1.5e0 THEN 'not_near_low'
                  WHEN ratio < 2e0 THEN 'insufficient_volume'
                  WHEN pct <= 1.02e0 THEN 'bullish_breakout_near_low'
                  ELSE 'breakout_confirmation' END AS type,
             CASE WHEN pct <= 1.5e0 AND ratio >= 2e0 THEN round(pct, 3) END AS pct_from_low,
             CASE WHEN pct <= 1.5e0 AND ratio >= 2e0 THEN round(ratio, 1) END AS volume_ratio,
             CASE WHEN pct <= 1.5e0 AND ratio >= 2e0 THEN CASE WHEN ratio >= 4e0 THEN 'extreme'
                  WHEN ratio >= 2.5e0 THEN 'strong' ELSE 'moderate' END END AS volume_strength
           FROM (SELECT *, volume / avg_volume_20d AS ratio, price / low_52w AS pct FROM panel)""",
    ),
)
def breakout_type(spark, sf):
    found = screen.breakout_near_low(
        *[F.col(c) for c in ("price", "low_52w", "volume", "avg_volume_20d")], threshold=1.5
    )
    return panel(spark, sf).select("ticker", "price_date", found.alias("b")).select(
        "ticker", "price_date", "b.*"
    )


SCORE_SQL = """(3e-1 * greatest(least(rvol / 2e1, 1e0), 0e0)
    + 25e-2 * greatest(least(1e0 - (price / low_52w - 1e0) / 9e0, 1e0), 0e0)
    + 2e-1 * greatest(least(volume / 1e6, 1e0), 0e0)
    + 15e-2 * greatest(least((5e1 - rsi) / 3e1, 1e0), 0e0)
    + 1e-1 * greatest(least(price_vs_sma50_pct / 2e0, 1e0), 0e0))"""


@query(
    "priority_score",
    "C-24",
    sql(
        "panel",
        f"""SELECT symbol, price_date, score,
              CASE WHEN score >= 80 THEN 'extreme' WHEN score >= 60 THEN 'strong'
                   WHEN score >= 40 THEN 'moderate' ELSE 'weak' END AS alert_level
            FROM (SELECT ticker AS symbol, price_date, round({SCORE_SQL} * 100, 4) AS score
                  FROM panel WHERE n_bars > 250 AND {WIDE_SQL})""",
    ),
)
def priority_score(spark, sf):
    catches = screen.screen(features(spark, sf), WIDE)
    return screen.priority_score(catches, WIDE).select("symbol", "price_date", "score", "alert_level")


@query(
    "priority_percentile",
    "C-24",
    sql(
        "panel",
        """SELECT symbol, price_date, round(100 * (3e-1 * coalesce(r_rvol, 0) + 25e-2 * coalesce(r_near, 0) + 2e-1 * coalesce(r_volume, 0)
                  + 15e-2 * coalesce(r_rsi, 0) + 1e-1 * coalesce(r_momentum, 0)), 6) AS score,
                  CAST(rank() OVER (ORDER BY round(100 * (3e-1 * coalesce(r_rvol, 0) + 25e-2 * coalesce(r_near, 0) + 2e-1 * coalesce(r_volume, 0)
                  + 15e-2 * coalesce(r_rsi, 0) + 1e-1 * coalesce(r_momentum, 0)), 6) DESC) AS BIGINT) AS rank
           FROM (SELECT ticker AS symbol, price_date,
                   percent_rank() OVER (ORDER BY rvol) AS r_rvol,
                   percent_rank() OVER (ORDER BY -(CASE WHEN low_52w > 0 THEN price / low_52w ELSE 0 END)) AS r_near,
                   percent_rank() OVER (ORDER BY volume) AS r_volume,
                   CASE WHEN rsi IS NOT NULL THEN percent_rank() OVER (PARTITION BY rsi IS NULL ORDER BY -rsi) END AS r_rsi,
                   percent_rank() OVER (ORDER BY price_vs_sma50_pct) AS r_momentum
                 FROM panel)""",
    ),
)
def priority_percentile(spark, sf):
    """Percent ranks of five components over the whole panel, weighted, and the rank of the score."""
    near = F.when(F.col("low_52w") > 0, F.col("price") / F.col("low_52w")).otherwise(0.0)
    rows = features(spark, sf, gated=False).withColumn("pct_from_low", near)
    scored = ranks.percentile_score(rows, keep=["symbol", "price_date"]).select("symbol", "price_date", F.round("score", 6).alias("score"))
    scored = written(scored, "scores")
    counts = scored.groupBy((-F.col("score")).alias("_down")).agg(F.count("*").alias("n"))
    places = ranks.running_counts(counts, [], "_down")
    return scored.join(places, -F.col("score") == F.col("_down")).select("symbol", "price_date", "score", (F.col("below") + 1).alias("rank"))


@query(
    "top_priorities",
    "C-24 O-1",
    sql(
        "panel",
        f"""SELECT symbol, price_date, score,
                   row_number() OVER (ORDER BY score DESC, symbol, price_date) AS rank
            FROM (SELECT ticker AS symbol, price_date, round({SCORE_SQL} * 100, 4) AS score
                  FROM panel WHERE n_bars > 250 AND {WIDE_SQL})
            QUALIFY rank <= 20""",
    ),
)
def top_priorities(spark, sf):
    catches = screen.screen(features(spark, sf), WIDE)
    scored = screen.priority_score(catches, WIDE)
    return screen.top_scored(scored, 20, ["symbol", "price_date"]).select(
        "symbol", "price_date", "score", "rank"
    )


OFFLINE = """
    stats AS (SELECT ticker, min(low) AS low_52w, max(high) AS high_52w FROM bars
              WHERE price_date BETWEEN DATE '2001-11-04' - 365 AND DATE '2001-11-04' GROUP BY ticker),
    cur AS (SELECT ticker, close AS last_price, volume, price_date FROM bars
            QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY price_date DESC) = 1),
    judged AS (
        SELECT ticker, company_name, last_price, low_52w, high_52w, volume,
               (last_price - low_52w) / low_52w * 100 AS above,
               (high_52w - last_price) / high_52w * 100 AS below
        FROM fundamentals JOIN cur USING (ticker) JOIN stats USING (ticker) WHERE last_price > 0),
    offline AS (
        SELECT *, concat_ws(';',
            CASE WHEN above > (1.03e0 - 1) * 100 THEN 'above 52w low limit' END,
            CASE WHEN volume < 50000 THEN 'low volume' END,
            CASE WHEN below < 50 THEN 'too close to 52w high' END,
            CASE WHEN last_price < 1e0 THEN 'below minimum price' END,
            CASE WHEN last_price > 1e3 THEN 'above maximum price' END) AS reasons
        FROM judged)"""


def _offline(spark, sf):
    bars = tables.bars(spark, sf)
    return screen.offline_screen(
        tables.fundamentals(spark, sf),
        market_summary(bars, LAST_DAY),
        DEFAULT,
    )


@query(
    "offline_screen",
    "C-16 J-9",
    sql(
        "bars fundamentals",
        """SELECT ticker, company_name, last_price, volume, round(above, 6) AS pct_above_low, reasons,
                  reasons = '' AS passed FROM offline""",
        OFFLINE,
    ),
)
def offline_screen(spark, sf):
    return _offline(spark, sf).select(
        "ticker", "company_name", "last_price", "volume",
        F.round("pct_above_low", 6).alias("pct_above_low"),
        F.array_join("reasons", ";").alias("reasons"),
        "passed",
    )


@query(
    "offline_screen_summary",
    "A-14 C-16",
    sql(
        "bars fundamentals",
        """SELECT count(*) AS processed, count(*) FILTER (reasons = '') AS succeeded,
                  round(count(*) FILTER (reasons = '') * 1e2 / count(*), 1) AS rate_pct FROM offline""",
        OFFLINE,
    ),
)
def offline_screen_summary(spark, sf):
    from lowtide.operators.reports import success_rate

    return success_rate(_offline(spark, sf), F.col("passed"))


STORED = replace(
    WIDE, price_52w_low_pct=3.0, price_52w_high_pct=0.9, min_volume=20_000, rsi_enabled=False
)
STORED_SQL = """
    stored AS (
        SELECT q.ticker, q.last_price AS price, coalesce(q.volume, 0) AS volume,
               f.xml_52w_low AS low_52w, f.xml_52w_high AS high_52w, q.last_updated
        FROM latest q JOIN tickers t USING (ticker) LEFT JOIN fundamentals f USING (ticker)
        WHERE coalesce(q.last_price, 0) <> 0),
    caught AS (
        SELECT *, (price - low_52w) / low_52w * 100 AS above FROM stored
        WHERE price > 0 AND (low_52w IS NULL OR NOT low_52w > 0 OR (price / low_52w <= 3e0
              AND (high_52w IS NULL OR NOT high_52w > 0 OR price / high_52w <= 9e-1)))
          AND volume >= 20000 AND price BETWEEN 1e0 AND 1e3)"""


@query(
    "stored_quote_screen",
    "C-18 J-10 F-20",
    sql(
        "latest tickers fundamentals",
        """SELECT ticker AS symbol, price, volume,
             CASE WHEN low_52w > 0 THEN format('{:.1f}', round(above, 1)) || '% from 52w low'
                  ELSE 'No 52w low baseline (Volume Catch)' END
             || CASE WHEN volume > 0 THEN '; Vol: ' || format('{:,}', volume) ELSE '' END AS reason
           FROM caught""",
        STORED_SQL,
    ),
)
def stored_quote_screen(spark, sf):
    return screen.stored_quote_screen(
        tables.tickers(spark, sf),
        json_docs.latest_quotes(tables.raw_quotes(spark, sf), ["event_id"]),
        tables.fundamentals(spark, sf),
        STORED,
        legacy_stored=True,
    ).select("symbol", "price", "volume", "reason")


@query(
    "stored_screen_with_features",
    "C-18 C-10 C-11 C-12",
    sql(
        "panel fundamentals",
        """SELECT ticker AS symbol, price, volume, round(rvol, 6) AS rvol, round(rsi, 6) AS rsi
           FROM (SELECT * FROM panel
                 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY price_date DESC) = 1) p
           JOIN (SELECT ticker, xml_52w_low, xml_52w_high FROM fundamentals) f USING (ticker)
           WHERE price > 0 AND (volume >= 10000 OR rvol >= 2e0) AND rvol <= 2e1 AND price <= 1e3
             AND price >= 1e0 AND coalesce(rsi BETWEEN 20 AND 80, FALSE)
             AND (xml_52w_low IS NULL OR NOT xml_52w_low > 0 OR price / xml_52w_low <= 1e3)
           UNION ALL
           SELECT ticker, price, volume, round(rvol, 6), round(rsi, 6)
           FROM (SELECT * FROM panel
                 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY price_date DESC) = 1) p
           WHERE ticker NOT IN (SELECT ticker FROM fundamentals)
             AND price > 0 AND (volume >= 10000 OR rvol >= 2e0) AND rvol <= 2e1 AND price <= 1e3
             AND price >= 1e0 AND coalesce(rsi BETWEEN 20 AND 80, FALSE)""",
    ),
)
def stored_screen_with_features(spark, sf):
    bars = tables.bars(spark, sf)
    newest = ind.latest_per_key(ind.feature_panel(bars), ["ticker"], ["price_date"])
    criteria = replace(
        WIDE, price_52w_low_pct=1000.0, price_52w_high_pct=0, min_volume=10_000, rsi_max=80
    )
    return screen.stored_quote_screen(
        tables.tickers(spark, sf),
        current_quotes(bars),
        tables.fundamentals(spark, sf),
        criteria,
        features=newest,
    ).select(
        "symbol", "price", "volume", F.round("rvol", 6).alias("rvol"), F.round("rsi", 6).alias("rsi")
    )


@query(
    "low_proximity_scan",
    "C-20",
    sql(
        "bars",
        """SELECT ticker, close AS price, low_52w, round(close / low_52w, 6) AS pct_from_low
           FROM (SELECT ticker, close FROM bars
                 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY price_date DESC) = 1)
           JOIN (SELECT ticker, min(low) AS low_52w FROM bars
                 WHERE price_date BETWEEN DATE '2001-11-04' - 365 AND DATE '2001-11-04'
                 GROUP BY ticker) USING (ticker)
           WHERE close / low_52w <= 1e1""",
    ),
)
def low_proximity_scan(spark, sf):
    return screen.low_proximity_scan(tables.bars(spark, sf), LAST_DAY, WIDE).withColumn(
        "pct_from_low", F.round("pct_from_low", 6)
    )


@query(
    "two_phase_screen",
    "C-21",
    sql(
        "panel",
        f"""SELECT ticker AS symbol, price_date, price FROM panel
            JOIN (SELECT ticker FROM ticks
                  QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY price_date DESC) = 1
                          AND c / 1e4 BETWEEN 1e0 AND 1e3 AND v > 0) hopeful USING (ticker)
            WHERE n_bars > 250 AND {WIDE_SQL}""",
    ),
)
def two_phase_screen(spark, sf):
    bars = tables.bars(spark, sf)
    cheap = current_quotes(bars).select(
        F.col("ticker").alias("symbol"), F.col("last_price").alias("price"), "volume"
    )
    gated = lambda b: ind.with_history_gate(ind.feature_panel(b), 250)
    return screen.two_phase_screen(bars, cheap, gated, WIDE).select("symbol", "price_date", "price")


@query(
    "fallback_chain",
    "C-23",
    sql(
        "panel",
        f"""SELECT ticker AS symbol, price_date, price, 'history' AS source FROM panel
            WHERE n_bars > 250 AND {WIDE_SQL}""",
    ),
)
def fallback_chain(spark, sf):
    """Scanner, stored and history; the first two find nothing in these data."""
    rows = written(screen.screen(features(spark, sf), replace(WIDE, min_price=None, max_price=None)), "features")
    found = lambda criteria: screen.screen(rows, criteria)
    pick = lambda df, name: df.select(
        "symbol", "price_date", "price", F.lit(name).alias("source")
    )
    return screen.first_nonempty(
        [
            pick(found(replace(WIDE, min_price=1e9, max_price=None)), "scanner"),
            pick(found(replace(WIDE, max_price=0.001, min_price=None)), "stored"),
            pick(found(WIDE), "history"),
        ]
    )


@query(
    "fallback_stops",
    "C-23",
    sql(
        "panel",
        f"""SELECT ticker AS symbol, price_date, price, 'stored' AS source FROM panel
            WHERE n_bars > 250 AND price < 500 AND {WIDE_SQL}""",
    ),
)
def fallback_stops(spark, sf):
    """The second of three sources has rows, so the third adds none."""
    rows = written(screen.screen(features(spark, sf), replace(WIDE, min_price=None, max_price=None)), "features")
    pick = lambda df, name: df.select(
        "symbol", "price_date", "price", F.lit(name).alias("source")
    )
    return screen.first_nonempty(
        [
            pick(screen.screen(rows, replace(WIDE, min_price=1e9, max_price=None)), "scanner"),
            pick(screen.screen(rows, WIDE).filter("price < 500"), "stored"),
            pick(screen.screen(rows, WIDE), "history"),
        ]
    )


@query(
    "stored_screen_with_caps",
    "C-18 F-12",
    sql(
        "latest tickers listings",
        """SELECT q.ticker AS symbol, last_price AS price, volume, CAST(usd AS BIGINT) AS usd_mcap
           FROM latest q JOIN tickers USING (ticker) JOIN stated f USING (ticker)
           WHERE last_price BETWEEN 1e0 AND 1e3 AND coalesce(volume, 0) >= 20000 AND usd >= floor
             AND (NOT low > 0 OR (last_price / low <= 3e0 AND (NOT high > 0 OR last_price / high <= 9e-1)))""",
        """stated AS (
             SELECT ticker, round(balance - 100.25e0, 2) AS low, round(balance + 100.25e0, 2) AS high,
                    coalesce(reg.min_cap_usd, 500000000) AS floor,
                    round(CASE WHEN balance NOT BETWEEN 4300 AND 4500 THEN key * 7e0 + 100 END * 1e6
                      * CASE CASE WHEN balance >= 1000 THEN 'INR' WHEN ticker LIKE '%.%' THEN reg_currency END
                          WHEN 'INR' THEN 0.012e0 WHEN 'CAD' THEN 0.74e0 ELSE 1e0 END) AS usd
             FROM listings LEFT JOIN reg ON reg.exchange = listings.exchange AND ticker LIKE '%.%'
             WHERE balance >= -900)""",
    ),
)
def stored_screen_with_caps(spark, sf):
    """Company documents state millions of local currency; the cap floor is in dollars."""
    good, _ = xml_docs.flatten_snapshots(tables.company_xml(spark, sf))
    return screen.stored_quote_screen(
        tables.tickers(spark, sf),
        json_docs.latest_quotes(tables.raw_quotes(spark, sf), ["event_id"]),
        xml_docs.in_dollars(good, dims.fx_rates(spark)),
        replace(STORED, mcap_enabled=True),
        legacy_stored=True,
    ).select("symbol", "price", "volume", F.round("usd_mcap").cast("bigint").alias("usd_mcap"))


@query(
    "legacy_cap_screen",
    "C-2",
    sql(
        "fundamentals",
        """SELECT ticker AS symbol, market_cap_usd FROM fundamentals
           WHERE mkt_cap_usd >= CASE WHEN ticker LIKE '%.NS' OR ticker LIKE '%.JK'
                 OR ticker LIKE '%.BK' THEN 150000000 ELSE 500000000 END""",
    ),
)
def legacy_cap_screen(spark, sf):
    rows = tables.fundamentals(spark, sf).select(
        F.col("ticker").alias("symbol"),
        "market_cap_usd",
        (F.col("mkt_cap_usd") / 1e9).alias("usd_mcap"),
        F.lit(1.0).alias("price"),
    )
    rules = screen.predicates(rows, DEFAULT, legacy_exchange_map=True)
    return rows.filter(rules["market_cap"]).select("symbol", "market_cap_usd")


@query(
    "reused_decisions",
    "J-17 F-24",
    sql(
        "tickers ev",
        """SELECT t.ticker, coalesce(d.k < 50, FALSE) AS should_skip,
                  coalesce('k=' || d.k, '') AS reason, d.k IS NOT NULL AS cached
           FROM tickers t LEFT JOIN (
             SELECT ticker, k FROM ev WHERE ts >= TIMESTAMP '2024-02-01' - INTERVAL 72 HOUR
             QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts DESC, event_id DESC) = 1) d
           USING (ticker)""",
    ),
)
def reused_decisions(spark, sf):
    from lowtide.criteria import version

    tag = version(DEFAULT)
    return lookups.reuse_decisions(
        tables.tickers(spark, sf),
        tables.decisions(spark, sf, tag),
        tag,
        tables.EVENTS_TIME,
        ttl_hours=72,
    )


@query(
    "daily_scan",
    "C-22 C-23 C-18 C-19 J-10",
    sql(
        "panel tickers directory fundamentals",
        """SELECT p.ticker AS symbol, p.price, p.volume, round(p.rvol, 6) AS rvol, 'stored' AS source
           FROM (SELECT * FROM panel
                 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY price_date DESC) = 1) p
           JOIN tickers t ON t.ticker = p.ticker
           LEFT JOIN fundamentals f ON f.ticker = p.ticker
           WHERE p.n_bars > 250
             AND t.market IN ('NSE', 'ASX', 'SGX', 'SEHK', 'LSE', 'JSE', 'TADAWUL', 'IDX', 'SET')
             AND (status = 'ACTIVE' OR status IS NULL
                  OR t.last_updated < TIMESTAMP '2001-11-05 00:00:00' - INTERVAL 200 DAY)
             AND price > 0 AND (volume >= 20000 OR rvol >= 2e0) AND rvol <= 2e1 AND price BETWEEN 1e0 AND 1e3
             AND (xml_52w_low IS NULL OR NOT xml_52w_low > 0 OR (price / xml_52w_low <= 3e0
                  AND (xml_52w_high IS NULL OR NOT xml_52w_high > 0 OR price / xml_52w_high <= 9e-1)))""",
    ),
)
def daily_scan_query(spark, sf):
    """The whole daily run: universe, stored quotes, features, screen, fallback."""
    from lowtide.plans import daily_scan

    source = daily_scan.Tables(
        tickers=tables.tickers(spark, sf),
        directory=tables.directory(spark, sf),
        bars=tables.bars(spark, sf),
        fundamentals=tables.fundamentals(spark, sf),
    )
    found = daily_scan.run(spark, source, dims.MARKET_FLAGS, STORED, tables.UNIVERSE_TIME)
    return found.select("symbol", "price", "volume", F.round("rvol", 6).alias("rvol"), "source")
