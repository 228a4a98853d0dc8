"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lowtide import dims
from lowtide.checks.base import query, sql
from lowtide.functions import symbols
from lowtide.functions.values import currency_of
from lowtide.operators import lookups
from lowtide.operators.exports import catch_rows
from lowtide.operators.reports import distinct_in_order
from lowtide.sources import benchmark_tables as tables
from lowtide.sources import json_docs
from lowtide.sources.tables import union_all


def latest(spark, sf):
    return json_docs.latest_quotes(tables.raw_quotes(spark, sf), ["event_id"])


@query(
    "quotes_with_fundamentals",
    "J-1",
    sql(
        "latest fundamentals",
        """SELECT q.ticker, q.last_price, q.volume, f.company_name, f.sector, f.market_cap_usd
           FROM latest q LEFT JOIN fundamentals f USING (ticker)""",
    ),
)
def quotes_with_fundamentals(spark, sf):
    return lookups.with_fundamentals(
        latest(spark, sf), tables.fundamentals(spark, sf), ["company_name", "sector", "market_cap_usd"]
    ).select("ticker", "last_price", "volume", "company_name", "sector", "market_cap_usd")


@query(
    "orphan_bars",
    "J-2",
    sql(
        "bars fundamentals",
        """SELECT count(*) AS orphans FROM bars b LEFT JOIN fundamentals f USING (ticker)
           WHERE f.symbol IS NULL""",
    ),
)
def orphan_bars(spark, sf):
    return lookups.orphan_count(tables.bars(spark, sf), tables.fundamentals(spark, sf))


@query(
    "orphan_quotes",
    "J-3",
    sql(
        "latest fundamentals",
        """SELECT count(*) AS orphans FROM latest q LEFT JOIN fundamentals f USING (ticker)
           WHERE f.symbol IS NULL""",
    ),
)
def orphan_quotes(spark, sf):
    return lookups.orphan_count(latest(spark, sf), tables.fundamentals(spark, sf))


@query(
    "orphans_left_anti",
    "J-4 J-16",
    sql(
        "listings fundamentals",
        "SELECT ticker, kind FROM listings ANTI JOIN fundamentals USING (ticker)",
    ),
)
def orphans_left_anti(spark, sf):
    return lookups.missing_from(
        tables.listings(spark, sf).select("ticker", "kind"), tables.fundamentals(spark, sf)
    )


@query(
    "without_quote",
    "J-5",
    sql(
        "tickers ev",
        """SELECT t.ticker FROM tickers t
           WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.ticker
                 || CASE WHEN event_type = 'view' AND ev.ticker LIKE '%.NS' THEN '.NS' ELSE '' END = t.ticker
                 AND event_type <> 'signup')""",
    ),
)
def without_quote(spark, sf):
    return lookups.without_payload(
        tables.tickers(spark, sf).select("ticker"), tables.raw_quotes(spark, sf), "market_data"
    )


@query(
    "quotes_inner_fundamentals",
    "J-6",
    sql(
        "latest fundamentals",
        """SELECT ticker, last_price, f.pe_ratio FROM latest JOIN fundamentals f USING (ticker)""",
    ),
)
def quotes_inner_fundamentals(spark, sf):
    return lookups.with_fundamentals(
        latest(spark, sf), tables.fundamentals(spark, sf), ["pe_ratio"], how="inner"
    ).select("ticker", "last_price", "pe_ratio")


@query(
    "not_in_null_aware",
    "J-7",
    sql(
        "tickers fundamentals",
        """SELECT ticker FROM tickers WHERE ticker NOT IN (SELECT ticker FROM fundamentals)
           ORDER BY ticker LIMIT 5""",
    ),
)
def not_in_null_aware(spark, sf):
    rows = lookups.not_in(tables.tickers(spark, sf), tables.fundamentals(spark, sf))
    return rows.select("ticker").orderBy("ticker").limit(5)


@query(
    "not_in_with_null_key",
    "J-7",
    sql(
        "tickers fundamentals",
        """SELECT ticker FROM tickers
           WHERE ticker NOT IN (SELECT company_name FROM fundamentals)
           UNION ALL
           SELECT ticker FROM tickers
           WHERE ticker NOT IN (SELECT ticker FROM fundamentals WHERE company_name IS NULL)""",
    ),
)
def not_in_with_null_key(spark, sf):
    """Against names, of which some are NULL, nothing is left; against the tickers of those, most are."""
    tickers, known = tables.tickers(spark, sf).select("ticker"), tables.fundamentals(spark, sf)
    names = known.select(F.col("company_name").alias("ticker"))
    nameless = known.filter(F.col("company_name").isNull()).select("ticker")
    return lookups.not_in(tickers, names).unionByName(lookups.not_in(tickers, nameless))


@query(
    "large_caps_with_quote",
    "J-8 J-11",
    sql(
        "latest fundamentals",
        """SELECT ticker, last_price FROM latest
           WHERE ticker IN (SELECT ticker FROM fundamentals WHERE market_cap_usd > 500000000)""",
    ),
)
def large_caps_with_quote(spark, sf):
    large = tables.fundamentals(spark, sf).filter(F.col("market_cap_usd") > 500_000_000)
    return lookups.present_in(latest(spark, sf), large).select("ticker", "last_price")


@query(
    "fundamentals_batch",
    "J-11",
    sql(
        "ev fundamentals",
        """SELECT ticker, split_part(ticker, '.', 1) AS symbol, exchange, market_cap_usd
           FROM fundamentals WHERE ticker IN (SELECT ticker FROM ev)""",
    ),
)
def fundamentals_batch(spark, sf):
    wanted = tables.raw_quotes(spark, sf).select(
        symbols.undouble_suffix(F.col("ticker")).alias("ticker")
    )
    return lookups.present_in(tables.fundamentals(spark, sf), wanted).select(
        "ticker", symbols.base_symbol(F.col("ticker")).alias("symbol"), "exchange", "market_cap_usd"
    )


@query(
    "resume_split",
    "J-12",
    sql(
        "tickers ev",
        """SELECT t.ticker, CASE WHEN EXISTS (SELECT 1 FROM ev WHERE ev.ticker = t.ticker
                 AND NOT (event_type = 'view' AND ev.ticker LIKE '%.NS') AND event_type <> 'signup'
                 AND ts > TIMESTAMP '2024-02-01' - INTERVAL 3 DAY) THEN 'skip' ELSE 'fetch' END AS action
           FROM tickers t""",
    ),
)
def resume_split(spark, sf):
    stored = tables.raw_quotes(spark, sf).withColumnRenamed("market_data", "payload")
    return lookups.split_by_age(
        tables.tickers(spark, sf).select("ticker"), stored, tables.EVENTS_TIME, 3
    )


@query(
    "resume_cap",
    "O-7 J-12",
    sql(
        "tickers ev",
        """SELECT t.ticker FROM tickers t WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.ticker = t.ticker
                 AND NOT (event_type = 'view' AND ev.ticker LIKE '%.NS') AND event_type <> 'signup'
                 AND ts > TIMESTAMP '2024-02-01' - INTERVAL 3 DAY)
           ORDER BY t.ticker LIMIT 50""",
    ),
)
def resume_cap(spark, sf):
    """The first 50 of what is still to be fetched."""
    from lowtide.operators.reports import capped

    return capped(resume_split(spark, sf).filter("action = 'fetch'"), ["ticker"], 50).select("ticker")


@query(
    "market_lookup",
    "J-13 F-7",
    sql(
        "directory",
        """SELECT ticker, market, coalesce(reg.market_type, 'MAJOR') AS market_type,
                  CAST(coalesce(reg.min_cap_usd, 500000000) AS BIGINT) AS min_cap_usd,
                  coalesce(reg.suffix, '') AS suffix
           FROM directory LEFT JOIN reg ON reg.exchange = directory.market""",
    ),
)
def market_lookup(spark, sf):
    rows = tables.directory(spark, sf).select("ticker", "market")
    return lookups.with_market(rows, spark, "market")


@query(
    "fx_mcap",
    "J-13 F-12",
    sql(
        "fundamentals",
        """SELECT ticker, currency, round(mkt_cap_usd * coalesce(rate, 1e0), 2) AS usd_mkt_cap_usd,
                  rate IS NULL AS fx_missing
           FROM fundamentals LEFT JOIN (VALUES ('INR', 0.012e0), ('IDR', 0.000064e0), ('THB', 0.028e0),
             ('USD', 1e0), ('CAD', 0.74e0)) fx(cur, rate) ON fx.cur = currency""",
    ),
)
def fx_mcap(spark, sf):
    rows = tables.fundamentals(spark, sf).select("ticker", "currency", "mkt_cap_usd")
    return lookups.with_fx(rows, dims.fx_rates(spark), "mkt_cap_usd").select(
        "ticker", "currency", F.round("usd_mkt_cap_usd", 2).alias("usd_mkt_cap_usd"), "fx_missing"
    )


@query(
    "suffix_currency",
    "F-12",
    sql(
        "tickers",
        """SELECT ticker, CASE WHEN ticker LIKE '%.NS' THEN 'INR' WHEN ticker LIKE '%.JK' THEN 'IDR'
             WHEN ticker LIKE '%.BK' THEN 'THB' WHEN ticker LIKE '%.TO' THEN 'CAD'
             WHEN ticker LIKE '%.T' THEN 'JPY' ELSE 'USD' END AS currency FROM tickers""",
    ),
)
def suffix_currency(spark, sf):
    return tables.tickers(spark, sf).select("ticker", currency_of(F.col("ticker")).alias("currency"))


@query(
    "exchange_by_suffix_join",
    "J-14 F-3",
    sql(
        "directory",
        """SELECT d.ticker, coalesce(reg.exchange, '') AS exchange FROM directory d
           LEFT JOIN reg ON reg.suffix <> '' AND d.ticker LIKE '%.%'
             AND reg.suffix = '.' || split_part(d.ticker, '.', -1)""",
    ),
)
def exchange_by_suffix_join(spark, sf):
    return lookups.with_exchange(tables.directory(spark, sf).select("ticker"), spark)


@query(
    "distinct_tickers_first_seen",
    "A-15 U-2",
    sql(
        "ev",
        "SELECT ticker, min(event_id) AS first_seen FROM ev GROUP BY ticker",
    ),
)
def distinct_tickers_first_seen(spark, sf):
    rows = tables.raw_quotes(spark, sf).select(
        symbols.undouble_suffix(F.col("ticker")).alias("ticker"), "event_id"
    )
    return distinct_in_order(rows, "ticker", F.col("event_id"))


@query(
    "union_of_lists",
    "U-2",
    sql(
        "tickers fundamentals directory",
        """SELECT ticker FROM tickers UNION SELECT ticker FROM fundamentals
           UNION SELECT ticker FROM directory""",
    ),
)
def union_of_lists(spark, sf):
    lists = [
        t(spark, sf).select("ticker") for t in (tables.tickers, tables.fundamentals, tables.directory)
    ]
    return union_all(lists).distinct()


@query(
    "concatenated_markets",
    "U-3",
    sql(
        "tickers",
        """SELECT ticker FROM tickers WHERE market IN ('NSE', 'LSE')
           UNION ALL SELECT ticker FROM tickers WHERE market = 'LSE'""",
    ),
)
def concatenated_markets(spark, sf):
    from lowtide.operators.universe import union_markets

    universe = tables.tickers(spark, sf)
    parts = [universe.filter(F.col("market") == m).select("ticker") for m in ("NSE", "LSE", "LSE")]
    return union_markets(parts)


@query(
    "large_caps_missing",
    "U-4",
    sql(
        "latest fundamentals",
        """SELECT ticker FROM fundamentals WHERE market_cap_usd > 500000000
           EXCEPT SELECT ticker FROM latest""",
    ),
)
def large_caps_missing(spark, sf):
    large = tables.fundamentals(spark, sf).filter(F.col("market_cap_usd") > 500_000_000)
    return lookups.key_difference(large, latest(spark, sf))


@query(
    "catches_concat",
    "U-5 K-14",
    sql(
        "bars",
        """SELECT ticker, (CAST(close * 1e4 AS BIGINT) + 50) // 100 / 1e2 AS price, volume, 0e0 AS usd_mcap, 0e0 AS pct_from_low, '' AS reason,
                  TIMESTAMP '2001-11-05 00:00:00' AS timestamp
           FROM bars""",
    ),
)
def catches_concat(spark, sf):
    rows = tables.bars(spark, sf).select(F.col("ticker").alias("symbol"), F.col("close").alias("price"), "volume", "price_date")
    edge = F.lit("2001-10-20").cast("date")
    old = catch_rows(rows.filter(F.col("price_date") < edge), tables.UNIVERSE_TIME)
    new = catch_rows(rows.filter(F.col("price_date") >= edge), tables.UNIVERSE_TIME)
    return old.unionByName(new)
