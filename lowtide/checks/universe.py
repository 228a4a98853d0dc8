"""Universe selection and tickers' lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from lowtide import dims
from lowtide.checks.base import query, sql
from lowtide.functions import symbols, text, values
from lowtide.operators import universe as uni
from lowtide.operators.reports import market_freshness, row_counts
from lowtide.sources import benchmark_tables as tables
from lowtide.sources import json_docs
from lowtide.sources import tables as readers
from lowtide.sources.benchmark_tables import LAST_DAY, UNIVERSE_TIME

ASOF = "TIMESTAMP '2001-11-05 00:00:00'"
ACTIVE = "(status = 'ACTIVE' OR status IS NULL)"


@query(
    "actionable_keys",
    "P-1",
    sql(
        "tickers",
        f"""SELECT ticker, market FROM tickers
            WHERE {ACTIVE} OR last_updated < {ASOF} - INTERVAL 200 DAY""",
    ),
)
def actionable_keys(spark, sf):
    return uni.actionable(tables.tickers(spark, sf), UNIVERSE_TIME).select("ticker", "market")


@query("active_tickers", "P-2 S-10", sql("tickers", f"SELECT ticker FROM tickers WHERE {ACTIVE}"))
def active_tickers(spark, sf):
    return readers.key_set(uni.active(tables.tickers(spark, sf)))


@query(
    "active_of_market",
    "P-2",
    sql("tickers", f"SELECT ticker FROM tickers WHERE market = 'SEHK' AND {ACTIVE}"),
)
def active_of_market(spark, sf):
    return uni.active(tables.tickers(spark, sf), "SEHK").select("ticker")


@query(
    "fresh_tickers",
    "P-3",
    sql(
        "tickers",
        f"SELECT ticker, market FROM tickers WHERE last_updated > {ASOF} - INTERVAL 100 DAY",
    ),
)
def fresh_tickers(spark, sf):
    return uni.fresh(tables.tickers(spark, sf), UNIVERSE_TIME, 100).select("ticker", "market")


@query(
    "allowed_caps",
    "P-4",
    sql(
        "directory",
        """SELECT ticker, market, market_cap_category FROM directory
           WHERE market NOT IN ('SEHK', 'LSE', 'JSE', 'TADAWUL', 'ASX', 'SGX')
              OR market_cap_category IN ('Large Cap', 'Mid Cap', 'Small Cap')""",
    ),
)
def allowed_caps(spark, sf):
    return uni.allowed_caps(tables.directory(spark, sf)).select(
        "ticker", "market", "market_cap_category"
    )


@query(
    "excluded_caps",
    "P-5",
    sql(
        "directory",
        "SELECT ticker FROM directory WHERE market_cap_category NOT IN ('Nano Cap', 'Micro Cap')",
    ),
)
def excluded_caps(spark, sf):
    return uni.without_small_caps(tables.directory(spark, sf)).select("ticker")


@query(
    "seed_from_tickers",
    "P-6",
    sql(
        "tickers",
        f"""SELECT ticker, 'active' AS mode FROM tickers WHERE market = 'LSE' AND {ACTIVE}
            UNION ALL SELECT ticker, 'all' FROM tickers WHERE market = 'LSE'""",
    ),
)
def seed_from_tickers(spark, sf):
    universe, listed = tables.tickers(spark, sf), tables.directory(spark, sf)
    active = uni.seed_tickers(universe, listed, "LSE").withColumn("mode", F.lit("active"))
    everything = uni.seed_tickers(universe, listed, "LSE", include_inactive=True)
    return active.unionByName(everything.withColumn("mode", F.lit("all")))


@query(
    "seed_from_directory",
    "P-6",
    sql(
        "directory",
        """SELECT ticker FROM directory
           WHERE market_cap_category IN ('Large Cap', 'Mid Cap', 'Small Cap')""",
    ),
)
def seed_from_directory(spark, sf):
    return uni.seed_tickers(
        tables.tickers(spark, sf), tables.directory(spark, sf), "NSE", "fd_capfilter"
    )


@query(
    "suffix_filter",
    "P-7 A-21",
    sql("fundamentals", "SELECT ticker, company_name FROM fundamentals WHERE ticker LIKE '%.NS'"),
)
def suffix_filter(spark, sf):
    return (
        tables.fundamentals(spark, sf)
        .filter(F.col("ticker").endswith(".NS"))
        .select("ticker", "company_name")
    )


@query(
    "valid_quotes",
    "P-8 P-11",
    sql(
        "latest",
        """SELECT ticker, last_price, close_price, volume,
                  round((last_price - close_price) / close_price * 100, 2) AS change_pct
           FROM latest WHERE last_price > 0""",
    ),
)
def valid_quotes(spark, sf):
    quotes = json_docs.latest_quotes(tables.raw_quotes(spark, sf), ["event_id"])
    return uni.quote_changes(quotes).select(
        "ticker", "last_price", "close_price", "volume", "change_pct"
    )


@query(
    "json_path_predicate",
    "P-9",
    "SELECT event_id FROM events WHERE CAST(props->>'$.k' AS BIGINT) >= 50",
)
def json_path_predicate(spark, sf):
    k = values.json_number(F.col("props"), "$.k")
    return tables.load(spark, sf, "events").filter(k >= 50).select("event_id")


@query(
    "high_caps",
    "P-10 O-2",
    sql(
        "fundamentals",
        """SELECT ticker, company_name, market_cap_usd FROM fundamentals
           WHERE market_cap_usd > 800000000""",
    ),
)
def high_caps(spark, sf):
    return uni.large_caps(tables.fundamentals(spark, sf), 800_000_000).select(
        "ticker", "company_name", "market_cap_usd"
    )


@query(
    "historical_ids",
    "P-12",
    """SELECT lpad(CAST(o_orderkey AS VARCHAR), 8, '0') || CASE WHEN o_orderstatus = 'P' THEN '.L' ELSE 'X.NS' END
              AS ticker FROM orders
       WHERE NOT regexp_matches(lpad(CAST(o_orderkey AS VARCHAR), 8, '0')
             || CASE WHEN o_orderstatus = 'P' THEN '.L' ELSE 'X.NS' END, '^0[A-Z0-9]+\\.L$')""",
)
def historical_ids(spark, sf):
    ids = tables.load(spark, sf, "orders").select(
        F.concat(
            F.lpad(F.col("o_orderkey").cast("string"), 8, "0"),
            F.when(F.col("o_orderstatus") == "P", ".L").otherwise("X.NS"),
        ).alias("ticker")
    )
    return ids.filter(~symbols.is_historical_id(F.col("ticker")))


def _requested(spark, sf):
    # nation names and exchange codes as requested markets
    names = tables.load(spark, sf, "nation").select(F.col("n_name").alias("code"))
    codes = tables.listings(spark, sf).select(F.lower("exchange").alias("code"))
    return names.unionByName(codes)


_MARKET_FLAGS = ", ".join(f"('{k}')" for k in dims.MARKET_FLAGS)


@query(
    "market_selection",
    "P-13",
    sql(
        "listings",
        """SELECT code, CASE WHEN code IN (SELECT lower(exchange) FROM reg)
                         OR code IN (SELECT flag FROM flags) THEN 'supported' ELSE 'unsupported' END AS support
           FROM (SELECT DISTINCT code FROM (SELECT lower(n_name) AS code FROM nation
                 UNION ALL SELECT lower(exchange) FROM listings))""",
        f"flags(flag) AS (VALUES {_MARKET_FLAGS})",
    ),
)
def market_selection(spark, sf):
    supported, unsupported = uni.selected_markets(spark, _requested(spark, sf))
    return supported.select("code", F.lit("supported").alias("support")).unionByName(
        unsupported.select("code", F.lit("unsupported").alias("support"))
    )


@query(
    "failure_gate",
    "P-14",
    sql(
        "tickers failures",
        """SELECT ticker FROM tickers WHERE ticker NOT IN
             (SELECT ticker FROM failures GROUP BY ticker HAVING count(*) >= 15)""",
    ),
)
def failure_gate(spark, sf):
    return uni.without_repeated_failures(
        tables.tickers(spark, sf), tables.failures(spark, sf), limit=15
    ).select("ticker")


@query(
    "fundamental_prefilter",
    "P-15",
    sql(
        "tickers fundamentals",
        f"""SELECT ticker,
              f_ticker IS NOT NULL AND ((market_cap_usd <> 0 AND market_cap_usd < floor) OR NOT is_active)
                AS can_skip,
              CASE WHEN f_ticker IS NULL THEN 'No cached fundamentals'
                   WHEN market_cap_usd <> 0 AND market_cap_usd < floor
                     THEN 'Market cap $' || format('{{:.0f}}', round(market_cap_usd / 1e6)) || 'M < threshold $'
                          || format('{{:.0f}}', floor / 1e6) || 'M'
                   WHEN NOT is_active THEN 'Stock no longer active'
                   WHEN age > 30 THEN 'Data ' || age || ' days old, needs refresh'
                   ELSE 'Passes fundamental filters' END AS reason
            FROM (SELECT t.ticker, f.ticker AS f_ticker, f.market_cap_usd, f.is_active,
                         CAST(reg.min_cap_usd AS BIGINT) AS floor,
                         datediff('day', f.last_updated, {ASOF}) AS age
                  FROM tickers t LEFT JOIN fundamentals f ON f.ticker = t.ticker
                  LEFT JOIN reg ON reg.exchange = f.exchange)""",
    ),
)
def fundamental_prefilter(spark, sf):
    return uni.fundamental_prefilter(
        tables.tickers(spark, sf), tables.fundamentals(spark, sf), UNIVERSE_TIME
    )


@query(
    "error_classes",
    "P-16",
    sql(
        "failures",
        """SELECT event_id, ticker, CASE WHEN regexp_matches(lower(message),
             'delisted|not found|404|no data found') THEN 'INACTIVE' ELSE 'RETRY' END AS new_status
           FROM failures""",
    ),
)
def error_classes(spark, sf):
    return uni.classify_failures(tables.failures(spark, sf)).select(
        "event_id", "ticker", "new_status"
    )


def _validity_sql(days: int, needed: int, why: str) -> str:
    return sql(
        "tickers bars",
        f"""SELECT t.ticker, coalesce(n, 0) AS recent_bars, coalesce(n, 0) >= {needed} AS is_valid,
                   CASE WHEN coalesce(n, 0) >= {needed} THEN 'Valid stock' ELSE '{why}' END AS reason
            FROM tickers t LEFT JOIN (SELECT ticker, count(*) AS n FROM bars
              WHERE price_date BETWEEN DATE '2001-11-04' - {days - 1} AND DATE '2001-11-04'
              GROUP BY ticker) b ON b.ticker = t.ticker""",
    )


@query("validity_quick", "P-17", _validity_sql(5, 3, "No recent trading data"))
def validity_quick(spark, sf):
    return uni.validity(tables.tickers(spark, sf), tables.bars(spark, sf), LAST_DAY)


@query("validity_full", "P-17", _validity_sql(365, 200, "Insufficient historical data"))
def validity_full(spark, sf):
    return uni.validity(tables.tickers(spark, sf), tables.bars(spark, sf), LAST_DAY, quick=False)


@query(
    "smallest_caps",
    "P-18",
    sql(
        "fundamentals",
        """SELECT ticker, market_cap_usd FROM fundamentals
           WHERE market_cap_usd > 0 AND market_cap_usd < 150000000
           ORDER BY market_cap_usd, ticker LIMIT 5""",
    ),
)
def smallest_caps(spark, sf):
    return uni.smallest_caps(tables.fundamentals(spark, sf)).select("ticker", "market_cap_usd")


@query(
    "prices_in_range",
    "P-19",
    sql(
        "bars fundamentals",
        """SELECT ticker, price_date, close FROM bars SEMI JOIN fundamentals USING (ticker)
           WHERE price_date BETWEEN DATE '1998-01-01' AND DATE '1998-03-31'""",
    ),
)
def prices_in_range(spark, sf):
    return uni.prices_between(
        tables.bars(spark, sf), "1998-01-01", "1998-03-31", tables.fundamentals(spark, sf)
    ).select("ticker", "price_date", "close")


@query(
    "prices_of_day",
    "P-19",
    sql("bars", "SELECT ticker, close, volume FROM bars WHERE price_date = DATE '1999-06-15'"),
)
def prices_of_day(spark, sf):
    return uni.prices_between(tables.bars(spark, sf), "1999-06-15", "1999-06-15").select(
        "ticker", "close", "volume"
    )


@query(
    "document_excerpts",
    "P-20",
    """SELECT doc_id, left(text, 100) AS excerpt, length(text) AS size,
              lang || ':' || source AS origin FROM documents""",
)
def document_excerpts(spark, sf):
    return tables.load(spark, sf, "documents").select(
        "doc_id",
        text.excerpt(F.col("text"), 100).alias("excerpt"),
        F.length("text").cast("bigint").alias("size"),
        F.concat("lang", F.lit(":"), "source").alias("origin"),
    )


_ENABLED = [k for k, on in dims.MARKET_FLAGS.items() if on]


@query(
    "universe_build",
    "C-22 U-3 A-4",
    sql(
        "tickers directory",
        f"""SELECT ticker, market FROM (
              SELECT s.ticker, s.market FROM scope s LEFT JOIN added a USING (ticker)
              WHERE {ACTIVE} OR (a.ticker IS NULL AND last_updated < {ASOF} - INTERVAL 200 DAY))
            UNION ALL
            SELECT ticker, market FROM added WHERE ticker NOT IN (SELECT ticker FROM tickers)""",
        f"""chosen AS (SELECT * FROM mkt WHERE market_flag IN ({", ".join(f"'{k}'" for k in _ENABLED)})),
        scope AS (SELECT * FROM tickers WHERE market IN (SELECT market FROM chosen)),
        stale AS (
            SELECT c.* FROM chosen c LEFT JOIN (
              SELECT market, count(*) FILTER (last_updated > {ASOF} - INTERVAL 7 DAY) AS recent
              FROM scope GROUP BY market) r ON r.market = c.market WHERE coalesce(recent, 0) < 100),
        added AS (
            SELECT DISTINCT CASE WHEN d.ticker LIKE '%' || s.suffix THEN d.ticker ELSE d.ticker || s.suffix END
                   AS ticker, s.market
            FROM directory d JOIN stale s ON s.directory_code = d.exchange
            WHERE s.market NOT IN ('SEHK', 'LSE', 'JSE', 'TADAWUL', 'ASX', 'SGX')
               OR market_cap_category IN ('Large Cap', 'Mid Cap', 'Small Cap'))""",
    ),
)
def universe_build(spark, sf):
    return uni.build_universe(
        spark,
        tables.tickers(spark, sf),
        tables.directory(spark, sf),
        dims.MARKET_FLAGS,
        UNIVERSE_TIME,
    )


@query(
    "market_freshness",
    "A-4",
    sql(
        "tickers",
        f"""SELECT market, recent, recent >= 50 AS is_fresh FROM (
              SELECT market, count(*) FILTER (last_updated > {ASOF} - INTERVAL 200 DAY) AS recent
              FROM tickers GROUP BY market)""",
    ),
)
def market_fresh(spark, sf):
    return market_freshness(tables.tickers(spark, sf), UNIVERSE_TIME, ttl_days=200, min_count=50)


@query(
    "inactive_count",
    "A-22",
    sql(
        "fundamentals",
        "SELECT 'inactive' AS table_name, count(*) AS row_count FROM fundamentals WHERE NOT is_active",
    ),
)
def inactive_count(spark, sf):
    return row_counts({"inactive": uni.inactive(tables.fundamentals(spark, sf))})
