"""The daily run: gate, universe, quotes, features, screen, catches.

``run`` computes what several sources share - bars, universe, features - once, asks the sources in their
order and stops at the first that has a row.  ``catches`` is the same as one lazy plan, for tables that
are cheap to read again."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lowtide.criteria import Criteria
from lowtide.operators import indicators, reports, screen
from lowtide.operators.bars import current_quotes
from lowtide.operators.lookups import present_in
from lowtide.operators.universe import build_universe
from lowtide.session import written


@dataclass(frozen=True)
class Tables:
    tickers: DataFrame
    directory: DataFrame
    bars: DataFrame
    fundamentals: DataFrame
    current: DataFrame | None = None  # by default the newest bar of each ticker


def ready(tables: Tables, asof, max_hours: int = 24) -> DataFrame:
    """Freshness gate: one row that says whether the scan may run."""
    return reports.freshness(tables.current, tables.bars, asof, max_hours)


def history_features(bars: DataFrame, tickers: DataFrame, criteria: Criteria) -> DataFrame:
    """Newest feature row per ticker of the universe.

    Bars outside the universe are removed before the windows, where they would cost most.
    """
    panel = indicators.with_history_gate(
        indicators.feature_panel(present_in(bars, tickers)), criteria.min_history_days
    )
    return indicators.latest_per_key(panel, ["ticker"], ["price_date"])


def _universe_and_features(spark, tables: Tables, enabled, criteria: Criteria, asof, keep) -> tuple[DataFrame, DataFrame]:
    universe = keep(build_universe(spark, tables.tickers, tables.directory, enabled, asof), "universe")
    return universe, keep(history_features(tables.bars, universe, criteria), "features")


def _sources(tables: Tables, universe, features, criteria: Criteria, asof, scanner, legacy_stored: bool) -> list[DataFrame]:
    """Catches of the scanner's hits (if any), of the stored quotes and of the history, in this order."""
    columns = ["symbol", "price", "volume", "usd_mcap", "pct_from_low", "rvol"]
    pick = lambda df, source: df.select(*columns, F.lit(source).alias("source"))
    by_quote = lambda quotes: screen.stored_quote_screen(
        universe, quotes, tables.fundamentals, criteria, features, legacy_stored
    )
    caps = tables.fundamentals.select(
        F.col("ticker").alias("symbol"), F.col("mkt_cap_usd").alias("usd_mcap")
    )
    history = screen.screen(
        features.withColumnRenamed("ticker", "symbol").join(caps, "symbol", "left"), criteria
    )
    sources = [pick(by_quote(tables.current), "stored"), pick(history, "history")]
    if scanner is not None:
        hits = scanner.select(
            F.col("symbol").alias("ticker"),
            F.col("price").alias("last_price"),
            "volume",
            F.lit(asof).cast("timestamp_ntz").alias("last_updated"),
        )
        sources.insert(0, pick(by_quote(hits), "scanner"))
    return sources


def run(
    spark: SparkSession,
    tables: Tables,
    enabled: dict[str, bool],
    criteria: Criteria,
    asof,
    *,
    scanner: DataFrame | None = None,
    legacy_stored: bool = False,
    max_hours: int = 24,
    only_first: bool = False,
) -> DataFrame:
    """Scanner hits first, then stored quotes, then history when these give nothing; see ``catches``.

    The bars are read once, and the panel is computed once, however many sources are asked; each source
    is written by the step that asks it, and whether it has a row tells if the next one is asked."""
    bars = written(tables.bars, "bars")
    tables = replace(tables, bars=bars, current=current_quotes(bars) if tables.current is None else tables.current)
    fresh = ready(tables, asof, max_hours).filter("is_fresh").limit(1).count() > 0
    universe, features = _universe_and_features(spark, tables, enabled, criteria, asof, written)
    sources = _sources(tables, universe, features, criteria, asof, scanner, legacy_stored)
    if not fresh:
        return sources[0].limit(0)
    for source in sources[:1] if only_first else sources:
        found = written(source, "catches")
        if not found.isEmpty():
            break
    return found


def catches(
    spark: SparkSession,
    tables: Tables,
    enabled: dict[str, bool],
    criteria: Criteria,
    asof,
    *,
    scanner: DataFrame | None = None,
    legacy_stored: bool = False,
    max_hours: int = 24,
    only_first: bool = False,
) -> DataFrame:
    """Scanner hits first, then stored quotes, then history when these give nothing.

    ``scanner`` has the hits of an outside scanner (symbol, price, volume), which are screened like
    stored quotes.  Without fresh market data (``ready``) the run gives no rows.  ``only_first``: see
    ``first_nonempty``."""
    if tables.current is None:
        tables = replace(tables, current=current_quotes(tables.bars))
    universe, features = _universe_and_features(spark, tables, enabled, criteria, asof, lambda df, name: df)
    sources = _sources(tables, universe, features, criteria, asof, scanner, legacy_stored)
    fresh = ready(tables, asof, max_hours).filter("is_fresh").exists()
    return screen.first_nonempty(sources, only_first).filter(fresh)
