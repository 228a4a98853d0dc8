"""Aggregated reports, rankings, digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from lowtide.checks.base import query, sql
from lowtide.checks.screens import WIDE, WIDE_SQL, features
from lowtide.operators import reports, screen
from lowtide.operators.bars import market_summary
from lowtide.operators.indicators import latest_per_key
from lowtide.session import written
from lowtide.sources import benchmark_tables as tables
from lowtide.sources.benchmark_tables import EVENTS_TIME, LAST_DAY, UNIVERSE_TIME

ASOF = "TIMESTAMP '2001-11-05 00:00:00'"


@query(
    "table_counts",
    "A-1",
    sql(
        "bars fundamentals latest",
        """SELECT 'bars' AS table_name, count(*) AS row_count FROM bars
           UNION ALL SELECT 'fundamentals', count(*) FROM fundamentals
           UNION ALL SELECT 'quotes', count(*) FROM latest""",
    ),
)
def table_counts(spark, sf):
    from lowtide.checks.joins import latest

    return reports.row_counts(
        {
            "bars": tables.bars(spark, sf),
            "fundamentals": tables.fundamentals(spark, sf),
            "quotes": latest(spark, sf),
        }
    )


@query(
    "latest_updates",
    "A-2",
    sql(
        "bars fundamentals",
        """SELECT (SELECT max(price_date) FROM bars) AS latest_price,
                  (SELECT max(last_updated) FROM fundamentals) AS latest_fundamentals""",
    ),
)
def latest_updates(spark, sf):
    return reports.latest_updates(tables.bars(spark, sf), tables.fundamentals(spark, sf))


@query(
    "data_freshness",
    "A-3",
    sql(
        "latest bars",
        """SELECT current_count, latest_update, round(hours, 4) AS hours_old, history_count,
                  current_count > 0 AND history_count > 0 AND round(hours, 4) <= 48 AS is_fresh
           FROM (SELECT count(*) AS current_count, max(last_updated) AS latest_update,
                   floor(date_diff('microsecond', max(last_updated), TIMESTAMP '2024-02-01') / 1e6) / 36e2 AS hours,
                   (SELECT count(*) FROM bars) AS history_count FROM latest)""",
    ),
)
def data_freshness(spark, sf):
    from lowtide.checks.joins import latest

    return reports.freshness(latest(spark, sf), tables.bars(spark, sf), EVENTS_TIME, max_hours=48)


_CAPS = """count(*) AS total_stocks, CAST(sum(market_cap_usd) AS DOUBLE) / count(market_cap_usd) AS avg_market_cap,
    min(market_cap_usd) AS min_market_cap, max(market_cap_usd) AS max_market_cap,
    count(*) FILTER (market_cap_usd < 100000000) AS under_100m,
    count(*) FILTER (market_cap_usd BETWEEN 100000000 AND 500000000) AS small_cap,
    count(*) FILTER (market_cap_usd > 500000000) AS mid_large_cap"""


@query("mcap_stats", "A-7", sql("fundamentals", f"SELECT {_CAPS} FROM fundamentals WHERE is_active"))
def mcap_stats(spark, sf):
    return reports.market_cap_stats(tables.fundamentals(spark, sf))


@query(
    "mcap_stats_exchange",
    "A-7",
    sql("fundamentals", f"SELECT {_CAPS} FROM fundamentals WHERE is_active AND exchange = 'NSE'"),
)
def mcap_stats_exchange(spark, sf):
    return reports.market_cap_stats(tables.fundamentals(spark, sf), "NSE")


@query(
    "below_threshold",
    "A-8",
    sql(
        "fundamentals",
        """SELECT count(*) AS n, min(market_cap_usd) AS min_cap, max(market_cap_usd) AS max_cap,
                  CAST(sum(market_cap_usd) AS DOUBLE) / count(*) AS avg_cap
           FROM fundamentals WHERE market_cap_usd > 0 AND market_cap_usd < 150000000""",
    ),
)
def below_threshold(spark, sf):
    return reports.below_threshold_stats(tables.fundamentals(spark, sf))


@query(
    "source_breakdown",
    "A-9",
    sql(
        "fundamentals",
        """SELECT data_source, count(*) AS n, count(*) FILTER (market_cap_usd > 0) AS n_matching
           FROM fundamentals GROUP BY data_source""",
    ),
)
def source_breakdown(spark, sf):
    return reports.source_breakdown(
        tables.fundamentals(spark, sf), "data_source", F.col("market_cap_usd") > 0
    )


@query(
    "completeness",
    "A-10",
    sql(
        "fundamentals",
        """SELECT count(*) AS total, count(company_name) AS has_first, count(xml_52w_low) AS has_second,
             count(*) FILTER (company_name IS NOT NULL AND xml_52w_low IS NOT NULL) AS has_both,
             count(*) FILTER (company_name IS NULL AND xml_52w_low IS NULL) AS has_neither,
             count(*) FILTER (company_name IS NOT NULL AND xml_52w_low IS NULL) AS only_first,
             count(*) FILTER (company_name IS NULL AND xml_52w_low IS NOT NULL) AS only_second
           FROM fundamentals""",
    ),
)
def completeness(spark, sf):
    return reports.completeness(tables.fundamentals(spark, sf), "company_name", "xml_52w_low")


@query(
    "group_counts",
    "A-11",
    sql(
        "tickers directory cache_entries",
        """SELECT 'market' AS what, market AS value, count(*) AS n FROM tickers GROUP BY market
           UNION ALL SELECT 'category', market_cap_category, count(*) FROM directory
             WHERE market_cap_category IS NOT NULL GROUP BY market_cap_category
           UNION ALL SELECT 'currency', currency, count(*) FROM directory WHERE currency IS NOT NULL GROUP BY currency
           UNION ALL SELECT 'data type', data_type, count(*) FROM cache_entries GROUP BY data_type""",
    ),
)
def group_counts(spark, sf):
    directory = tables.directory(spark, sf)
    parts = [
        ("market", reports.group_counts(tables.tickers(spark, sf), "market"), "market"),
        ("category", reports.group_counts(directory, "market_cap_category", drop_null=True), "market_cap_category"),
        ("currency", reports.group_counts(directory, "currency", drop_null=True), "currency"),
        ("data type", reports.group_counts(tables.cache_entries(spark, sf), "data_type"), "data_type"),
    ]
    from lowtide.sources.tables import union_all

    rows = union_all(
        [df.select(F.lit(name).alias("what"), F.col(c).alias("value"), "n") for name, df, c in parts]
    )
    return rows.orderBy("what", F.desc("n"), "value")


@query(
    "category_share",
    "A-12 W-13",
    sql(
        "directory",
        """SELECT market_cap_category, count(*) AS n,
                  round(count(*) * 1e2 / sum(count(*)) OVER (), 1) AS pct
           FROM directory WHERE market_cap_category IS NOT NULL GROUP BY market_cap_category""",
    ),
)
def category_share(spark, sf):
    return reports.category_share(tables.directory(spark, sf), "market_cap_category")


@query(
    "missing_audit",
    "A-13 U-1",
    sql(
        "fundamentals quotes",
        """SELECT table_name, total_records, missing, round(missing * 1e2 / total_records, 2) AS pct_missing FROM (
             SELECT 'fundamentals' AS table_name, count(*) AS total_records,
                    count(*) FILTER (company_name IS NULL) AS missing FROM fundamentals
             UNION ALL SELECT 'quotes', count(*), count(*) FILTER (close_price IS NULL OR close_price = 0) FROM quotes)""",
    ),
)
def missing_audit(spark, sf):
    from lowtide.sources.json_docs import parse_quotes

    close = F.col("close_price")
    return reports.missing_audit(
        [
            ("fundamentals", tables.fundamentals(spark, sf), F.col("company_name").isNull()),
            ("quotes", parse_quotes(tables.raw_quotes(spark, sf)), close.isNull() | (close == 0)),
        ]
    )


@query(
    "run_success",
    "A-14",
    sql(
        "ev",
        """SELECT count(*) AS processed, count(*) FILTER (event_type <> 'error') AS succeeded,
                  round(count(*) FILTER (event_type <> 'error') * 1e2 / count(*), 1) AS rate_pct FROM ev""",
    ),
)
def run_success(spark, sf):
    return reports.success_rate(
        tables.load(spark, sf, "events"), F.col("event_type") != "error"
    )


@query(
    "bars_per_ticker",
    "A-16",
    sql(
        "bars",
        """SELECT count(*) AS bars, count(DISTINCT ticker) AS tickers,
                  count(*) / count(DISTINCT ticker) AS bars_per_ticker FROM bars""",
    ),
)
def bars_per_ticker(spark, sf):
    return reports.bars_per_ticker(tables.bars(spark, sf))


_LINE = """CASE WHEN coalesce(rsi <= 25, FALSE) AND rvol >= 5 THEN '🔥'
        WHEN coalesce(rsi <= 35, FALSE) OR rvol >= 3 THEN '⚡' ELSE '📌' END
    || ' `' || ticker || '` — ' || coalesce(sign, '$')
    || format('{:,.2f}', (CAST(price * 1e4 AS BIGINT) + 50) // 100 / 1e2)
    || ' | +' || format('{:.1f}', round((price / low_52w - 1) * 100, 1)) || '%'
    || CASE WHEN rsi IS NOT NULL THEN ' | RSI ' || format('{:.0f}', round(rsi)) ELSE '' END
    || CASE WHEN rvol <> 0 THEN ' | RVOL ' || format('{:.1f}', round(rvol, 1)) || 'x' ELSE '' END
    || CASE WHEN atr_pct <> 0 THEN ' | ATR ' || format('{:.1f}', round(atr_pct * 100, 1)) || '%' ELSE '' END"""


@query(
    "digest_by_exchange",
    "A-17",
    sql(
        "panel disp",
        f"""SELECT coalesce(label, 'US/OTHER') AS label, 1 AS line_kind, ticker, price_date, {_LINE} AS line FROM hits
            UNION ALL
            SELECT coalesce(label, 'US/OTHER'), 0, '', NULL,
                   coalesce(flag, '🌐') || ' *' || coalesce(label, 'US/OTHER') || ' (' || count(*) || ')*'
            FROM hits GROUP BY label, flag""",
        f"""hits AS (SELECT * FROM panel LEFT JOIN disp
              ON ticker LIKE '%.%' AND disp.suffix = '.' || split_part(ticker, '.', -1)
            WHERE n_bars > 250 AND {WIDE_SQL})""",
    ),
)
def digest_by_exchange(spark, sf):
    catches = screen.screen(features(spark, sf), WIDE)
    columns = ["symbol", "price_date", "price", "pct_from_low", "rvol", "rsi", "atr_pct"]
    return reports.digest(written(catches.select(*columns), "catches"))


@query(
    "digest_title",
    "A-17",
    sql(
        "panel",
        f"""SELECT '📊 *DAILY SCAN — ' || count(*) || ' SIGNAL' || CASE WHEN count(*) > 1 THEN 'S' ELSE '' END || '*' AS title
            FROM panel WHERE n_bars > 250 AND {WIDE_SQL}""",
    ),
)
def digest_title(spark, sf):
    return reports.digest_title(screen.screen(features(spark, sf), WIDE))


@query(
    "listings_by_region",
    "A-18",
    sql(
        "directory",
        """SELECT region, string_agg(DISTINCT market_flag, ',' ORDER BY market_flag) AS markets, count(*) AS listings
           FROM directory JOIN mkt USING (market)
           JOIN (VALUES ('nse', 'india'), ('idx', 'emerging_asia'), ('set', 'emerging_asia')) r(market_flag, region)
             USING (market_flag) GROUP BY region""",
    ),
)
def listings_by_region(spark, sf):
    """Listings per region; the markets of a region are a dimension, not collected rows."""
    from lowtide import dims

    grouped = reports.markets_by_region(spark)
    sizes = (
        tables.directory(spark, sf)
        .groupBy("market")
        .agg(F.count("*").alias("n"))
        .join(F.broadcast(dims.universe_markets(spark).select("market_flag", "market")), "market")
    )
    return (
        grouped.select("region", "markets", F.explode("markets").alias("market_flag"))
        .join(sizes, "market_flag")
        .groupBy("region", F.array_join("markets", ",").alias("markets"))
        .agg(F.sum("n").alias("listings"))
    )


@query(
    "cache_age",
    "A-19",
    sql(
        "cache_entries",
        """SELECT count(*) AS entries, round(sum(age) / count(*) / 36e2, 4) AS avg_age_hours,
                  round(max(age) / 36e2, 4) AS max_age_hours, round(min(age) / 36e2, 4) AS min_age_hours
           FROM (SELECT CAST(floor(date_diff('microsecond', timestamp, TIMESTAMP '2024-02-01') / 1e6) AS BIGINT) AS age
                 FROM cache_entries)""",
    ),
)
def cache_age(spark, sf):
    return reports.cache_age(tables.cache_entries(spark, sf), EVENTS_TIME)


@query(
    "catches_by_market",
    "A-21",
    sql(
        "panel",
        f"""SELECT CASE WHEN ticker LIKE '%.NS' THEN 'India' WHEN ticker LIKE '%.TO' THEN 'Canada'
              WHEN ticker LIKE '%.JK' THEN 'Indonesia' WHEN ticker LIKE '%.BK' THEN 'Thailand' ELSE 'Other' END AS market,
              count(*) AS n FROM panel WHERE n_bars > 250 AND {WIDE_SQL} GROUP BY ALL""",
    ),
)
def catches_by_market(spark, sf):
    from lowtide.functions.text import exchange_by_region_suffix

    endings = {".NS": "India", ".TO": "Canada", ".JK": "Indonesia", ".BK": "Thailand"}
    market = exchange_by_region_suffix(F.col("symbol"), endings, "Other")
    return (
        screen.screen(features(spark, sf), WIDE)
        .groupBy(market.alias("market"))
        .agg(F.count("*").alias("n"))
    )


@query(
    "latest_cache_entry",
    "W-14",
    sql(
        "cache_entries",
        """SELECT cache_key, data, timestamp, data_type FROM cache_entries
           QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY timestamp DESC, event_id DESC) = 1""",
    ),
)
def latest_cache_entry(spark, sf):
    return latest_per_key(
        tables.cache_entries(spark, sf), ["cache_key"], ["timestamp", "event_id"]
    ).drop("event_id")


@query(
    "top_per_category",
    "W-15",
    sql(
        "directory",
        """SELECT market_cap_category, ticker, company_name, rn FROM (
             SELECT *, row_number() OVER (PARTITION BY market_cap_category ORDER BY company_name, ticker) AS rn
             FROM directory WHERE market_cap_category IN (
               SELECT market_cap_category FROM directory WHERE market_cap_category IS NOT NULL
               GROUP BY market_cap_category ORDER BY count(*) DESC, market_cap_category LIMIT 3))
           WHERE rn <= 5""",
    ),
)
def top_per_category(spark, sf):
    return reports.top_per_category(
        tables.directory(spark, sf), "market_cap_category", ["company_name", "ticker"]
    ).select("market_cap_category", "ticker", "company_name", F.col("rn").cast("bigint").alias("rn"))


@query(
    "nearest_to_low",
    "O-1",
    sql(
        "bars",
        """SELECT ticker, last_price, low_52w, round(last_price / low_52w, 8) AS pct_from_low FROM (
             SELECT ticker, close AS last_price FROM bars
             QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY price_date DESC) = 1)
           JOIN (SELECT ticker, min(low) AS low_52w FROM bars
                 WHERE price_date BETWEEN DATE '2001-11-04' - 365 AND DATE '2001-11-04' GROUP BY ticker) USING (ticker)
           ORDER BY last_price / low_52w, ticker LIMIT 10""",
    ),
)
def nearest_to_low(spark, sf):
    bars = tables.bars(spark, sf)
    rows = (
        market_summary(bars, LAST_DAY)
        .filter("bars_in_year > 0")
        .withColumn("pct_from_low", F.col("last_price") / F.col("low_52w"))
    )
    return reports.nearest_to_low(rows).select(
        "ticker", "last_price", "low_52w", F.round("pct_from_low", 8).alias("pct_from_low")
    )


@query(
    "caps_nulls_last",
    "O-2",
    sql(
        "fundamentals",
        """SELECT ticker, CASE WHEN xml_52w_low IS NOT NULL THEN market_cap_usd END AS cap FROM fundamentals
           ORDER BY cap DESC NULLS LAST, ticker""",
    ),
)
def caps_nulls_last(spark, sf):
    cap = F.when(F.col("xml_52w_low").isNotNull(), F.col("market_cap_usd"))
    rows = tables.fundamentals(spark, sf).select("ticker", cap.alias("cap"))
    return rows.orderBy(F.desc_nulls_last("cap"), "ticker")


@query(
    "universe_cap",
    "O-4 O-5",
    sql("tickers", "SELECT ticker, market FROM tickers ORDER BY market, ticker LIMIT 200"),
)
def universe_cap(spark, sf):
    return reports.capped(tables.tickers(spark, sf), ["market", "ticker"], 200).select("ticker", "market")


@query(
    "hashed_sample",
    "O-6",
    sql("tickers", "SELECT ticker FROM tickers ORDER BY md5(ticker || '|42'), ticker LIMIT 100"),
)
def hashed_sample(spark, sf):
    return reports.hashed_sample(tables.tickers(spark, sf).select("ticker"), "ticker", 100, "42")
