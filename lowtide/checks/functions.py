"""Scalar functions over whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from lowtide import dims
from lowtide.checks.base import query, sql, values_cte
from lowtide.functions import rules, symbols, text, values
from lowtide.sources import benchmark_tables as tables


def _symbols(spark, sf):
    """Padded order keys as symbols over all exchanges."""
    key = F.col("o_orderkey")
    n = len(dims.EXCHANGES)
    return tables.load(spark, sf, "orders").select(
        F.when(F.col("o_orderstatus") == "P", F.lpad(key.cast("string"), 4, "0"))
        .otherwise(key.cast("string"))
        .alias("symbol"),
        tables._exchange(key).alias("exchange"),
        (key % n).alias("idx"),
    )


_SYMBOLS = """syms AS (
    SELECT CASE WHEN o_orderstatus = 'P' THEN lpad(CAST(o_orderkey AS VARCHAR), greatest(4, 0), '0')
                ELSE CAST(o_orderkey AS VARCHAR) END AS symbol, reg.exchange, reg.suffix, symbol_rule
    FROM orders JOIN reg ON reg.idx = o_orderkey % 18)"""


@query(
    "symbol_normalise",
    "F-1 F-2",
    sql(
        "reg",
        """SELECT symbol, exchange,
             CASE WHEN symbol_rule = 'strip_leading_zeros'
                    THEN CASE WHEN ltrim(symbol, '0') = '' THEN symbol ELSE ltrim(symbol, '0') END
                  WHEN symbol_rule = 'trailing_period' AND length(symbol) <= 2 THEN symbol || '.'
                  ELSE symbol END AS vendor_symbol,
             CASE WHEN symbol_rule = 'strip_leading_zeros'
                    THEN CASE WHEN ltrim(symbol, '0') = '' THEN symbol ELSE ltrim(symbol, '0') END
                  ELSE symbol END || suffix AS ticker
           FROM syms""",
        _SYMBOLS,
    ),
)
def symbol_normalise(spark, sf):
    vendor = symbols.to_vendor_symbol(F.col("symbol"), F.col("exchange"))
    return (
        _symbols(spark, sf)
        .withColumn("vendor_symbol", vendor)
        .select(
            "symbol",
            "exchange",
            "vendor_symbol",
            symbols.from_vendor_symbol(F.col("vendor_symbol"), F.col("exchange")).alias("ticker"),
        )
    )


@query(
    "exchange_mappings",
    "F-3 F-4 F-5",
    sql(
        "tickers",
        """SELECT ticker, CASE WHEN ticker LIKE '%.%' THEN market ELSE '' END AS exchange,
             CASE WHEN market IN ('NSE', 'TSE', 'IDX', 'SET') THEN market ELSE 'SMART' END AS by_ending,
             CASE WHEN market IN ('NSE', 'TSE', 'ASX', 'SGX', 'IBIS', 'SBF', 'IDX', 'SET') THEN market
                  ELSE 'SMART' END AS by_content,
             CASE market WHEN 'NSE' THEN 'India' WHEN 'TSE' THEN 'Canada' WHEN 'IDX' THEN 'Indonesia'
                  WHEN 'SET' THEN 'Thailand' WHEN 'SMART' THEN 'United States' ELSE 'Unknown' END AS country
           FROM tickers""",
    ),
)
def exchange_mappings(spark, sf):
    ticker = F.col("ticker")
    return tables.tickers(spark, sf).select(
        "ticker",
        symbols.exchange_of(ticker).alias("exchange"),
        symbols.exchange_by_ending(ticker).alias("by_ending"),
        symbols.exchange_by_content(ticker).alias("by_content"),
        symbols.country_of_exchange(F.col("market")).alias("country"),
    )


@query(
    "contract_lookup",
    "F-6",
    sql(
        "tickers",
        """SELECT ticker,
             CASE WHEN market IN ('TSE', 'NSE', 'ASX', 'SGX', 'IBIS', 'SBF')
                  THEN split_part(ticker, '.', 1) ELSE ticker END AS symbol,
             CASE WHEN market IN ('TSE', 'NSE', 'ASX', 'SGX', 'IBIS', 'SBF', 'IDX', 'SET') THEN market
                  ELSE 'SMART' END AS exchange,
             CASE market WHEN 'TSE' THEN 'CAD' WHEN 'NSE' THEN 'INR' WHEN 'ASX' THEN 'AUD'
                  WHEN 'SGX' THEN 'SGD' WHEN 'IBIS' THEN 'EUR' WHEN 'SBF' THEN 'EUR'
                  WHEN 'IDX' THEN NULL WHEN 'SET' THEN NULL ELSE 'USD' END AS currency,
             market NOT IN ('IDX', 'SET') AS supported
           FROM tickers""",
    ),
)
def contract_lookup(spark, sf):
    return (
        tables.tickers(spark, sf)
        .select("ticker", symbols.contract_of(F.col("ticker")).alias("c"))
        .select("ticker", "c.*")
    )


@query(
    "market_defaults",
    "F-7",
    sql(
        "directory",
        """SELECT ticker, coalesce(market_type, 'MAJOR') AS market_type,
                  CAST(coalesce(min_cap_usd, 500000000) AS BIGINT) AS min_cap, coalesce(reg.suffix, '') AS ending
           FROM directory LEFT JOIN reg ON reg.exchange = directory.exchange""",
    ),
)
def market_defaults(spark, sf):
    exchange = F.col("exchange")
    return tables.directory(spark, sf).select(
        "ticker",
        symbols.market_type(exchange).alias("market_type"),
        symbols.min_market_cap(exchange).cast("bigint").alias("min_cap"),
        symbols.suffix_of_exchange(exchange).alias("ending"),
    )


@query(
    "suffix_appended",
    "F-8",
    sql(
        "directory",
        """SELECT ticker, CASE WHEN p_size > 25 THEN ticker ELSE ticker || market_suffix END AS listed
           FROM directory""",
    ),
)
def suffix_appended(spark, sf):
    endings = {row[2]: row[3] for row in dims.UNIVERSE_MARKETS}
    from lowtide.functions.lookup import lookup

    return tables.directory(spark, sf).select(
        "ticker",
        symbols.append_suffix(F.col("ticker"), lookup(endings, F.col("market"))).alias("listed"),
    )


_FORMS = ("", ".NS", ".NS.NS", ".NS.NSE", ".NSE")


@query(
    "ticker_standardise",
    "F-9 F-10 F-11",
    sql(
        "",
        """SELECT old, 'P' || p_partkey || '.NS' AS ticker, old <> 'P' || p_partkey || '.NS' AS changed,
                  replace(old, '.NS.NS', '.NS') AS undoubled, 'P' || p_partkey AS base
           FROM (SELECT p_partkey, 'P' || p_partkey || form AS old
                 FROM part JOIN forms ON forms.idx = p_size % 5)""",
        values_cte("forms", "idx, form", list(enumerate(_FORMS))),
    ),
)
def ticker_standardise(spark, sf):
    from lowtide.functions.lookup import lookup

    form = lookup(dict(enumerate(_FORMS)), F.col("p_size") % 5)
    old = F.concat(F.lit("P"), F.col("p_partkey").cast("string"), form)
    rows = tables.load(spark, sf, "part").select(old.alias("old"))
    return rows.select(
        "old",
        symbols.standardise(F.col("old")).alias("ticker"),
        (symbols.standardise(F.col("old")) != F.col("old")).alias("changed"),
        symbols.undouble_suffix(F.col("old")).alias("undoubled"),
        symbols.base_symbol(F.col("old")).alias("base"),
    )


@query(
    "standardise_counts",
    "F-9",
    sql(
        "tickers directory ev",
        """SELECT 'tickers' AS table_name, count(*) FILTER (ticker NOT LIKE '%.NS') AS changed_rows FROM tickers
           UNION ALL SELECT 'directory', count(*) FILTER (ticker NOT LIKE '%.NS') FROM directory
           UNION ALL SELECT 'quotes', count(*) FILTER (ticker NOT LIKE '%.NS' OR event_type = 'view') FROM ev""",
    ),
)
def standardise_counts(spark, sf):
    from lowtide.operators import reports

    return reports.standardise_counts(
        {
            "tickers": tables.tickers(spark, sf),
            "directory": tables.directory(spark, sf),
            "quotes": tables.raw_quotes(spark, sf),
        }
    )


@query(
    "id_variants",
    "F-11",
    sql(
        "tickers",
        """SELECT ticker AS master, split_part(ticker, '.', 1) AS vendor,
                  split_part(ticker, '.', 1) || '.NS' AS bars, split_part(ticker, '.', 1) || '.NS' AS directory
           FROM tickers""",
    ),
)
def id_variants(spark, sf):
    return tables.tickers(spark, sf).select(symbols.id_variants(F.col("ticker")).alias("v")).select("v.*")


@query(
    "clean_numbers",
    "F-13 F-15",
    """SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE value * 1000 END AS number,
              CASE WHEN event_type = 'view' THEN 0 ELSE CAST(round(value * 1000) AS BIGINT) END AS volume
       FROM (SELECT event_id, event_type, CAST(round(value * 100) AS BIGINT) / 1e2 AS value FROM events)""",
)
def clean_numbers(spark, sf):
    amount = F.floor(F.col("value") * 100 + 0.5) * 10
    raw = F.when(F.col("event_type") == "view", "n/a").otherwise(
        F.concat(F.lit(" "), F.format_number(amount, 0), F.lit(" "))
    )
    return (
        tables.load(spark, sf, "events")
        .withColumn("raw", raw)
        .select(
            "event_id",
            values.clean_number(F.col("raw")).alias("number"),
            values.volume_or_zero(F.col("raw")).alias("volume"),
        )
    )


@query(
    "clean_texts",
    "F-14 S-9",
    """SELECT event_id, CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN NULL ELSE event_type END AS kind,
              CASE WHEN event_type <> 'error' THEN value END AS value FROM events""",
)
def clean_texts(spark, sf):
    from lowtide.sources.tables import clean_missing

    kind = F.col("event_type")
    return clean_missing(
        tables.load(spark, sf, "events").select(
            "event_id",
            F.when(kind == "view", "  ").when(kind == "click", "NaN").otherwise(kind).alias("kind"),
            F.when(kind == "error", F.lit(float("nan"))).otherwise(F.col("value")).alias("value"),
        )
    )


@query(
    "cap_normalise",
    "F-18",
    sql(
        "fundamentals",
        "SELECT ticker, round(market_cap_usd / 1e6) * 1e6 AS in_billions, round(mkt_cap_usd) AS in_dollars FROM fundamentals",
    ),
)
def cap_normalise(spark, sf):
    billions = F.floor(F.col("mkt_cap_usd") / 1e6 + 0.5) / 1e3
    return tables.fundamentals(spark, sf).select(
        "ticker",
        F.floor(values.full_usd_cap(billions) + 0.5).cast("double").alias("in_billions"),
        F.when(F.col("mkt_cap_usd") < 1000, F.col("mkt_cap_usd"))
        .otherwise(values.full_usd_cap(F.col("mkt_cap_usd")))
        .alias("in_dollars"),
    )


@query(
    "display_money",
    "F-19",
    sql(
        "fundamentals",
        """SELECT ticker, CASE WHEN market_cap_usd = 0 THEN 'N/A'
                  WHEN market_cap_usd >= 1000000000 THEN '$' || format('{:.1f}', round(market_cap_usd / 1e9, 1)) || 'B'
                  ELSE '$' || format('{:.1f}', round(market_cap_usd / 1e6, 1)) || 'M' END AS short,
             format('{:,}', market_cap_usd) AS long,
             CASE WHEN pe_ratio <> 0 THEN format('{:.2f}', pe_ratio) ELSE 'None' END AS pe
           FROM fundamentals""",
    ),
)
def display_money(spark, sf):
    cap = F.col("market_cap_usd")
    return tables.fundamentals(spark, sf).select(
        "ticker",
        text.short_money(cap).alias("short"),
        text.thousands(cap).alias("long"),
        text.number_or_none(F.col("pe_ratio")).alias("pe"),
    )


@query(
    "signal_strength",
    "F-21",
    sql(
        "panel",
        """SELECT ticker, price_date, CASE WHEN coalesce(rsi <= 25, FALSE) AND rvol >= 5 THEN 'EXTREME'
             WHEN coalesce(rsi <= 35, FALSE) OR rvol >= 3 THEN 'STRONG' ELSE 'WATCH' END AS strength
           FROM panel""",
    ),
)
def signal_strength(spark, sf):
    from lowtide.checks.indicators import panel

    return panel(spark, sf).select(
        "ticker", "price_date", text.signal_strength(F.col("rsi"), F.col("rvol")).alias("strength")
    )


@query(
    "exchange_labels",
    "F-22 A-21",
    sql(
        "tickers disp",
        """SELECT ticker, coalesce(flag, '🌐') AS flag, coalesce(sign, '$') AS sign,
                  coalesce(label, 'US/OTHER') AS label
           FROM tickers LEFT JOIN disp ON ticker LIKE '%.%' AND disp.suffix = '.' || split_part(ticker, '.', -1)""",
    ),
)
def exchange_labels(spark, sf):
    return (
        tables.tickers(spark, sf)
        .select("ticker", text.display_info(F.col("ticker")).alias("d"))
        .select("ticker", "d.*")
    )


@query(
    "alert_lines",
    "F-23",
    sql(
        "panel disp",
        """SELECT ticker, price_date,
             CASE WHEN coalesce(rsi <= 25, FALSE) AND rvol >= 5 THEN '🔥'
                  WHEN coalesce(rsi <= 35, FALSE) OR rvol >= 3 THEN '⚡' ELSE '📌' END
             || ' `' || ticker || '` — ' || coalesce(sign, '$') || format('{:,.2f}', (CAST(price * 1e4 AS BIGINT) + 50) // 100 / 1e2)
             || ' | +' || format('{:.1f}', round((price / low_52w - 1) * 100, 1)) || '%'
             || CASE WHEN rsi IS NOT NULL THEN ' | RSI ' || format('{:.0f}', round(rsi)) ELSE '' END
             || CASE WHEN rvol <> 0 THEN ' | RVOL ' || format('{:.1f}', round(rvol, 1)) || 'x' ELSE '' END
             || CASE WHEN atr_pct <> 0 THEN ' | ATR ' || format('{:.1f}', round(atr_pct * 100, 1)) || '%' ELSE '' END
             AS line
           FROM panel LEFT JOIN disp ON ticker LIKE '%.%' AND disp.suffix = '.' || split_part(ticker, '.', -1)
           WHERE n_bars > 250""",
    ),
)
def alert_lines(spark, sf):
    from lowtide.checks.indicators import panel

    line = text.alert_line(
        F.col("ticker"), F.col("price"), F.col("price") / F.col("low_52w"), F.col("rvol"),
        F.col("rsi"), F.col("atr_pct"),
    )
    return (
        panel(spark, sf).filter(F.col("n_bars") > 250).select("ticker", "price_date", line.alias("line"))
    )


@query(
    "cache_keys",
    "F-24",
    "SELECT event_id, md5(user_id || '|' || event_type || '|' || props) AS cache_key FROM events",
)
def cache_keys(spark, sf):
    return tables.load(spark, sf, "events").select(
        "event_id",
        rules.cache_key(F.col("user_id").cast("string"), F.col("event_type"), F.col("props")).alias(
            "cache_key"
        ),
    )


@query(
    "quarterly_schedule",
    "F-25",
    """SELECT o_orderkey, start AND (last_update IS NULL OR age > 80) AS due,
              CASE WHEN NOT start THEN 'Not quarter start date'
                   WHEN last_update IS NULL THEN 'No previous fundamentals data found'
                   WHEN age > 80 THEN age || ' days since last update'
                   ELSE 'Last update was ' || age || ' days ago' END AS reason
       FROM (SELECT o_orderkey, month(day) IN (1, 4, 7, 10) AND day(day) = 1 AS start, last_update,
                    datediff('day', last_update, day) AS age
             FROM (SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS day,
                          CASE WHEN o_orderstatus <> 'P' THEN (o_orderdate - to_days(CAST(o_custkey % 160 AS INTEGER)))::DATE END
                            AS last_update FROM orders))""",
)
def quarterly_schedule(spark, sf):
    placed = F.col("o_orderdate").cast("date")
    rows = tables.load(spark, sf, "orders").select(
        "o_orderkey",
        F.trunc(placed, "month").alias("day"),
        F.when(
            F.col("o_orderstatus") != "P", F.date_sub(placed, (F.col("o_custkey") % 160).cast("int"))
        ).alias("last_update"),
    )
    return rows.select(
        "o_orderkey", rules.quarterly_update_due(F.col("day"), F.col("last_update")).alias("q")
    ).select("o_orderkey", "q.*")


_WINDOWS = values_cte("windows", "region, start_minute, end_minute, time_zone", dims.SCAN_WINDOWS)


@query(
    "scan_windows",
    "F-26",
    sql(
        "",
        """SELECT event_id, region, minute BETWEEN start_minute AND end_minute AS open,
                  timezone('UTC', timezone(time_zone,
                    CASE WHEN local > opening THEN opening + INTERVAL 1 DAY ELSE opening END)) AS next_start
           FROM (SELECT *, date_trunc('day', local)::TIMESTAMP + to_minutes(start_minute) AS opening,
                        date_part('hour', local) * 60 + date_part('minute', local) AS minute
                 FROM (SELECT event_id, w.*, timezone(time_zone, timezone('UTC', ts)) AS local
                       FROM events JOIN windows w ON w.region = CASE event_type WHEN 'view' THEN 'india'
                         WHEN 'click' THEN 'europe' WHEN 'error' THEN 'asia_pacific'
                         WHEN 'signup' THEN 'emerging_asia' ELSE 'north_america' END))""",
        _WINDOWS,
    ),
)
def scan_windows(spark, sf):
    from lowtide.functions.lookup import lookup

    region = lookup(
        {"view": "india", "click": "europe", "error": "asia_pacific", "signup": "emerging_asia"},
        F.col("event_type"),
        "north_america",
    )
    rows = (
        tables.load(spark, sf, "events")
        .select("event_id", "ts", region.alias("region"))
        .join(F.broadcast(dims.scan_windows(spark)), "region")
    )
    when = F.col("ts"), F.col("time_zone"), F.col("start_minute")
    return rows.select(
        "event_id",
        "region",
        rules.in_scan_window(*when, F.col("end_minute")).alias("open"),
        rules.next_scan_start(*when).alias("next_start"),
    )


@query(
    "history_periods",
    "F-27",
    """SELECT p_partkey, CASE WHEN d <= 30 THEN '1mo' WHEN d <= 90 THEN '3mo' WHEN d <= 180 THEN '6mo' ELSE '1y' END
              AS period FROM (SELECT p_partkey, p_size * 6 AS d FROM part)""",
)
def history_periods(spark, sf):
    return tables.load(spark, sf, "part").select(
        "p_partkey", rules.history_period(F.col("p_size") * 6).alias("period")
    )


@query(
    "vendor_error_actions",
    "F-30",
    sql(
        "failures",
        """SELECT event_id, CASE WHEN error_code = 200 THEN 'inactive' WHEN error_code = 354 THEN 'fallback'
             WHEN error_code IN (502, 504) AND retry_count < 3 THEN 'retry' ELSE 'log' END AS action
           FROM failures""",
    ),
)
def vendor_error_actions(spark, sf):
    return tables.failures(spark, sf).select(
        "event_id",
        rules.vendor_error_action(F.col("error_code"), F.col("retry_count")).alias("action"),
    )


@query(
    "quote_reasons",
    "F-20",
    sql(
        "panel",
        """SELECT ticker, price_date, format('{:.1f}', round((price - low_52w) / low_52w * 100, 1))
             || '% from 52w low; Vol: ' || format('{:,}', volume) AS reason FROM panel WHERE n_bars > 250""",
    ),
)
def quote_reasons(spark, sf):
    from lowtide.checks.indicators import panel

    return panel(spark, sf).filter(F.col("n_bars") > 250).select(
        "ticker",
        "price_date",
        text.screening_reason(F.col("price"), F.col("low_52w"), F.col("volume")).alias("reason"),
    )
