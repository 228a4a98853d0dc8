"""Screening predicates and the jobs built from them.

A feature row has one column per field; a field that a source does not provide is a
missing *column*, and its predicate then uses the documented default.  A NULL inside the
``rsi`` column means "undefined" (flat window) and fails; NULL elsewhere counts as absent.
Every predicate is null-safe by itself, as Spark does not promise evaluation order.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lowtide import dims
from lowtide.criteria import PRESETS, SCORE_WEIGHTS, Criteria, apply_preset
from lowtide.functions import symbols
from lowtide.functions.lookup import first_match, lookup
from lowtide.functions.text import screening_reason
from lowtide.functions.values import full_usd_cap
from lowtide.operators.bars import market_summary
from lowtide.operators.lookups import present_in


def _field(df: DataFrame, name: str, default) -> Column:
    """The column, or the default where it is absent."""
    if name not in df.columns:
        return F.lit(default)
    return F.coalesce(F.col(name), F.lit(default)) if default is not None else F.col(name)


# --- patterns (fixed values: the labels of strengths and kinds) ----------------------------


def volume_spike(volume: Column, avg_volume: Column, threshold: float = 1.5) -> Column:
    """Struct (confirmed, ratio, strength) of today's volume against its average."""
    usable = F.coalesce(avg_volume > 0, F.lit(False))
    ratio = F.when(usable, volume / avg_volume)
    strength = (
        F.when(~usable, "insufficient_data")
        .when(ratio >= 4.0, "extreme")
        .when(ratio >= 2.5, "strong")
        .when(ratio >= threshold, "moderate")
        .otherwise("weak")
    )
    return F.struct(
        F.coalesce(ratio >= threshold, F.lit(False)).alias("confirmed"),
        F.coalesce(F.round(ratio, 1), F.lit(0.0)).alias("ratio"),
        strength.alias("strength"),
    )


def breakout_near_low(
    price: Column, low_52w: Column, volume: Column, avg_volume: Column, threshold: float = 0.98
) -> Column:
    """Struct (detected, type, pct_from_low, volume_ratio, volume_strength)."""
    spike = volume_spike(volume, avg_volume, 2.0)
    valid = F.coalesce(low_52w > 0, F.lit(False))
    ratio = F.when(valid, price / low_52w)
    near = F.coalesce(ratio <= threshold, F.lit(False))
    detected = near & spike["confirmed"]
    kind = (
        F.when(~valid, "invalid_data")
        .when(~near, "not_near_low")
        .when(~spike["confirmed"], "insufficient_volume")
        .when(ratio <= 1.02, "bullish_breakout_near_low")
        .otherwise("breakout_confirmation")
    )
    return F.struct(
        detected.alias("detected"),
        kind.alias("type"),
        F.when(detected, F.round(ratio, 3)).alias("pct_from_low"),
        F.when(detected, spike["ratio"]).alias("volume_ratio"),
        F.when(detected, spike["strength"]).alias("volume_strength"),
    )


# --- the chain -----------------------------------------------------------------------------


def cap_exchange(symbol: Column, legacy: bool = False) -> Column:
    """Exchange whose cap threshold applies; the legacy rule knows four suffixes only."""
    if legacy:
        return lookup(
            dims.LEGACY_SUFFIX_EXCHANGE, symbols.suffix(symbol), dims.UNKNOWN_EXCHANGE
        )
    return symbols.exchange_of(symbol)


def predicates(
    df: DataFrame, criteria: Criteria, *, legacy_exchange_map: bool = False
) -> dict[str, Column]:
    """All predicates in screening order, by name.  Switched-off ones are left out."""
    false = F.lit(False)
    price = _field(df, "price", 0.0)
    low = _field(df, "low_52w", 0.0)
    high = _field(df, "high_52w", 0.0)
    volume = _field(df, "volume", 0)
    rvol = _field(df, "rvol", 0.0)
    from_low = F.try_divide(price, F.nullif(low, F.lit(0.0)))
    has_low = low > 0

    rules: dict[str, Column] = {
        "required": F.coalesce((F.col("symbol") != "") & (price > 0), false)
    }
    if criteria.mcap_enabled:
        floor = symbols.min_market_cap(cap_exchange(F.col("symbol"), legacy_exchange_map))
        rules["market_cap"] = full_usd_cap(_field(df, "usd_mcap", 0.0)) >= floor
    rules["near_low"] = ~has_low | F.coalesce(from_low <= criteria.price_52w_low_pct, false)
    if criteria.price_52w_high_pct > 0:
        from_high = F.try_divide(price, F.nullif(high, F.lit(0.0)))
        rules["below_high"] = (
            ~has_low | ~(high > 0) | F.coalesce(from_high <= criteria.price_52w_high_pct, false)
        )
    rules["liquid"] = (volume >= criteria.min_volume) | (rvol >= criteria.min_rvol)
    if criteria.max_rvol is not None:
        rules["rvol_cap"] = rvol <= criteria.max_rvol
    if criteria.min_avg_volume_20d is not None:
        average = _field(df, "avg_volume_20d", 0.0)
        rules["avg_volume"] = ~(average > 0) | (average >= criteria.min_avg_volume_20d)
    if criteria.min_days_since_low is not None or criteria.max_days_since_low is not None:
        days = _field(df, "days_since_low", None)
        at_least = 1 if criteria.min_days_since_low is None else criteria.min_days_since_low
        at_most = 30 if criteria.max_days_since_low is None else criteria.max_days_since_low
        rules["low_age"] = F.coalesce(days.between(at_least, at_most), F.lit(True))
    if criteria.min_price is not None:
        rules["min_price"] = price >= criteria.min_price
    if criteria.max_price is not None:
        rules["max_price"] = price <= criteria.max_price
    if criteria.rsi_enabled:
        rsi = F.col("rsi") if "rsi" in df.columns else F.lit(50.0)
        rules["rsi"] = F.coalesce(rsi.between(criteria.rsi_min, criteria.rsi_max), false)
    if criteria.ma_enabled:
        rules["ma_support"] = (
            _field(df, "price_vs_sma50_pct", 1.0) >= criteria.price_vs_sma50_pct
        ) & (_field(df, "sma50_vs_sma200_pct", 1.0) >= criteria.sma50_vs_sma200_pct)
    if criteria.atr_enabled:
        rules["atr"] = _field(df, "atr_pct", 0.05).between(
            criteria.atr_min_pct, criteria.atr_max_pct
        )
    if (
        criteria.pattern_enabled
        and criteria.breakout_enabled
        and criteria.volume_confirmation_required
    ):
        average = F.coalesce(_field(df, "avg_volume_20d", None), volume)
        breakout = breakout_near_low(price, low, volume, average, criteria.price_52w_low_pct)
        spike = volume_spike(volume, average, criteria.min_volume_spike_ratio)
        rules["pattern"] = breakout["detected"] | spike["confirmed"]
    if criteria.fundamental_enabled:
        rules["leverage"] = _field(df, "debt_to_equity", 0.0) <= criteria.max_debt_to_equity
        rules["current_ratio"] = _field(df, "current_ratio", 2.0) >= criteria.min_current_ratio
    return rules


def _all_of(conditions: list[Column]) -> Column:
    return reduce(and_, conditions)


def screen(df: DataFrame, criteria: Criteria, **options) -> DataFrame:
    """Rows that pass every criterion, with ``pct_from_low`` (0 when the low is missing)."""
    passed = df.filter(_all_of(list(predicates(df, criteria, **options).values())))
    return passed.withColumn("pct_from_low", _pct_from_low(df))


def _pct_from_low(df: DataFrame) -> Column:
    low = _field(df, "low_52w", 0.0)
    return F.when(low > 0, F.col("price") / low).otherwise(0.0)


def explain_screen(df: DataFrame, criteria: Criteria, **options) -> DataFrame:
    """Every row with one boolean per criterion and the verdict."""
    rules = predicates(df, criteria, **options)
    return df.withColumns(
        {
            **{f"ok_{name}": rule for name, rule in rules.items()},
            "passed": _all_of(list(rules.values())),
        }
    )


def funnel(df: DataFrame, criteria: Criteria, **options) -> DataFrame:
    """How many rows are left after each stage: (stage_no, stage, remaining).

    One pass over the data.  Each row is first reduced to the number of stages it survives,
    then all stages are counted from that one number.
    """
    rules = predicates(df, criteria, **options)
    names = ["input", *rules]
    failed = [(~rule, F.lit(i)) for i, rule in enumerate(rules.values())]
    survived = df.select(first_match(failed, F.lit(len(rules))).alias("_survived"))
    counts = survived.agg(
        *[F.count_if(F.col("_survived") >= i).alias(f"n{i}") for i in range(len(names))]
    )
    stages = F.array(
        *[
            F.struct(
                F.lit(i).cast("bigint").alias("stage_no"),
                F.lit(name).alias("stage"),
                F.col(f"n{i}").alias("remaining"),
            )
            for i, name in enumerate(names)
        ]
    )
    return counts.select(F.inline(stages))


def compare_presets(
    df: DataFrame, base: Criteria, presets: list[str], overlays: dict[str, dict] = PRESETS
) -> DataFrame:
    """Rows and distinct symbols that pass under each preset, in one pass."""
    verdicts = {
        name: _all_of(list(predicates(df, apply_preset(base, name, overlays)).values()))
        for name in presets
    }
    # one row per symbol, then one in all; a preset that nobody passes is reported with zero
    per_symbol = df.groupBy("symbol").agg(*[F.count_if(ok).alias(name) for name, ok in verdicts.items()])
    totals = per_symbol.agg(
        *[F.coalesce(F.sum(name), F.lit(0)).alias(f"{name}_rows") for name in presets],
        *[F.count_if(F.col(name) > 0).alias(f"{name}_symbols") for name in presets],
    )
    rows = [
        F.struct(
            F.lit(name).alias("preset"),
            F.col(f"{name}_rows").alias("passing_rows"),
            F.col(f"{name}_symbols").alias("passing_symbols"),
        )
        for name in presets
    ]
    return totals.select(F.inline(F.array(*rows)))


def screen_with_presets(df: DataFrame, base: Criteria, presets: list[str]) -> DataFrame:
    """Each passing row once per preset it passes; at most ``len(presets)`` copies."""
    hits = [
        F.when(_all_of(list(predicates(df, apply_preset(base, n)).values())), F.lit(n))
        for n in presets
    ]
    return df.withColumn("preset", F.explode(F.array_compact(F.array(*hits))))


# --- priority score -------------------------------------------------------------------------


def _unit(value: Column) -> Column:
    return F.coalesce(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def priority_score(catches: DataFrame, criteria: Criteria) -> DataFrame:
    """Weighted score 0-100 and alert level per catch.

    Components are scaled by the criteria themselves, so a score depends on its own row
    only: no global ranking and no shuffle, and scores of different runs are comparable.
    """
    cap = criteria.max_rvol or 20.0
    low_span = max(criteria.price_52w_low_pct - 1.0, 1e-9)
    rsi_span = max(float(criteria.rsi_max - criteria.rsi_min), 1e-9)
    parts = {
        "rvol": _unit(F.col("rvol") / cap),
        "price_proximity": _unit(1.0 - (F.col("pct_from_low") - 1.0) / low_span),
        "volume": _unit(F.col("volume") / F.lit(20.0 * criteria.min_volume)),
        "rsi": _unit((F.lit(float(criteria.rsi_max)) - F.col("rsi")) / rsi_span),
        "momentum": _unit(F.col("price_vs_sma50_pct") / 2.0),
    }
    total = sum((parts[name] * weight for name, weight in SCORE_WEIGHTS.items()), F.lit(0.0))
    scored = catches.withColumn("score", F.round(total * 100, 4))
    return scored.withColumn(
        "alert_level",
        F.when(F.col("score") >= 80, "extreme")
        .when(F.col("score") >= 60, "strong")
        .when(F.col("score") >= 40, "moderate")
        .otherwise("weak"),
    )


def top_scored(scored: DataFrame, k: int, tie_break: list[str]) -> DataFrame:
    """The k best scores with their rank; only k rows ever meet in one place."""
    order = [F.desc("score"), *tie_break]
    best = scored.orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


# --- screens over stored tables -----------------------------------------------------------------


def offline_screen(fundamentals: DataFrame, market: DataFrame, criteria: Criteria) -> DataFrame:
    """Stored-table screen: every check is evaluated and the failed ones are listed.

    ``market`` has the newest quote and the extremes of the year (``bars.market_summary``).
    Volume alone decides liquidity, a missing value fails its check, and the limits are
    applied as percentages.  Tickers without a quote or without bars are left out.
    """
    known = market.filter((F.col("last_price") > 0) & (F.col("bars_in_year") > 0))
    rows = fundamentals.select("ticker", "company_name", "mkt_cap_usd").join(
        known.select("ticker", "last_price", "volume", "low_52w", "high_52w"), "ticker"
    )
    price, low, high, volume = (F.col(c) for c in ("last_price", "low_52w", "high_52w", "volume"))
    above_low = F.when(low > 0, (price - low) / low * 100)
    below_high = F.when(high > 0, (high - price) / high * 100)
    low_limit = (criteria.price_52w_low_pct - 1) * 100
    high_limit = criteria.price_52w_high_pct * 100
    reasons = F.array_compact(
        F.array(
            F.when(
                F.coalesce(above_low > low_limit, F.lit(True)),
                F.when(above_low.isNull(), "no 52w low").otherwise("above 52w low limit"),
            ),
            F.when(
                F.coalesce(volume < criteria.min_volume, F.lit(True)),
                F.when(F.coalesce(volume, F.lit(0)) == 0, "no volume").otherwise("low volume"),
            ),
            F.when(below_high < high_limit, "too close to 52w high"),
            F.when(price < criteria.min_price, "below minimum price"),
            F.when(price > criteria.max_price, "above maximum price"),
        )
    )
    return rows.withColumns({"pct_above_low": above_low, "reasons": reasons}).withColumn(
        "passed", F.size("reasons") == 0
    )


def stored_quote_screen(
    tickers: DataFrame,
    quotes: DataFrame,
    fundamentals: DataFrame,
    criteria: Criteria,
    features: DataFrame | None = None,
    legacy_stored: bool = False,
) -> DataFrame:
    """Screen the latest stored quotes of the given tickers.

    ``fundamentals.mkt_cap_usd`` holds whole dollars (``xml_docs.in_dollars`` converts what company
    documents state).
    Rolling features are joined in when given; ``legacy_stored`` reproduces the older
    behaviour that knows none of them and takes RVOL as 1.
    """
    rows = (
        present_in(quotes, tickers)
        .filter(F.coalesce(F.col("last_price"), F.lit(0.0)) != 0)
        .join(
            fundamentals.select(
                "ticker",
                F.col("xml_52w_low").alias("low_52w"),
                F.col("xml_52w_high").alias("high_52w"),
                F.coalesce(F.col("mkt_cap_usd"), F.lit(0.0)).alias("usd_mcap"),
            ),
            "ticker",
            "left",
        )
        .select(
            F.col("ticker").alias("symbol"),
            F.col("last_price").alias("price"),
            F.coalesce("volume", F.lit(0)).cast("bigint").alias("volume"),
            "low_52w",
            "high_52w",
            "usd_mcap",
            F.col("last_updated").alias("time"),
        )
    )
    if legacy_stored or features is None:
        rows = rows.withColumn("rvol", F.lit(1.0))
    else:
        extra = features.select(
            F.col("ticker").alias("symbol"),
            "rvol",
            "avg_volume_20d",
            "days_since_low",
            F.col("rsi").alias("_rsi"),
            "price_vs_sma50_pct",
            "sma50_vs_sma200_pct",
            "atr_pct",
            F.lit(True).alias("_known"),
        )
        rows = (
            rows.join(extra, "symbol", "left")
            .withColumn("rsi", F.when(F.col("_known"), F.col("_rsi")).otherwise(50.0))
            .drop("_rsi", "_known")
        )
    passed = screen(rows, criteria)
    return passed.withColumn(
        "reason", screening_reason(F.col("price"), F.col("low_52w"), F.col("volume"))
    )


def low_proximity_scan(bars: DataFrame, asof, criteria: Criteria, days: int = 365) -> DataFrame:
    """Tickers whose newest close is near the low of the past year; no other check."""
    ratio = F.col("close_asof") / F.col("low_52w")
    return (
        market_summary(bars, asof, days)
        .filter(F.col("bars_in_year") > 0)
        .select("ticker", F.col("close_asof").alias("price"), "low_52w", ratio.alias("pct_from_low"))
        .filter(F.col("pct_from_low") <= criteria.price_52w_low_pct)
    )


def two_phase_screen(bars: DataFrame, cheap: DataFrame, panel, criteria: Criteria) -> DataFrame:
    """Costly features only for tickers that pass the cheap checks.

    ``cheap``: symbol, price, volume per ticker; ``panel``: function bars -> features.
    A filter on other columns is never pushed below a window, so the semi join does it.
    """
    hopeful = cheap.filter(
        (F.col("price") > 0)
        & F.coalesce(F.col("price") >= criteria.min_price, F.lit(True))
        & F.coalesce(F.col("price") <= criteria.max_price, F.lit(True))
        & (F.col("volume") > 0)
    ).select(F.col("symbol").alias("ticker"))
    features = panel(present_in(bars, hopeful))
    return screen(features.withColumnRenamed("ticker", "symbol"), criteria)


def first_nonempty(sources: list[DataFrame], only_first: bool = False) -> DataFrame:
    """Rows of the first source that has any; sources share one schema.

    One lazy plan: each source is filtered by existence tests over those before it, which stop at
    their first row.  ``only_first`` keeps the older behaviour, where an empty answer of the first
    source already counts as an answer."""
    found = sources[0]
    if only_first:
        return found
    none_before = F.lit(True)
    for before, source in zip(sources, sources[1:]):
        none_before = none_before & ~before.exists()
        found = found.unionByName(source.filter(none_before))
    return found
