"""Query registration and the SQL form of the benchmark adapters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lowtide import dims


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a query under a name, with the operator ids it covers and its SQL twin."""

    def add(run):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, tuple(covers.split()), run, sql)
        return run

    return add


# --- SQL fragments -----------------------------------------------------------------------------


def literal(value) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def values_cte(name: str, columns: str, rows) -> str:
    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


N_EXCHANGES = len(dims.EXCHANGES)
N_MARKETS = len(dims.UNIVERSE_MARKETS)

CTES = {
    "reg": values_cte(
        "reg",
        "idx, exchange, market_type, min_cap_usd, provider, suffix, currency, symbol_rule",
        [(i, *row) for i, row in enumerate(dims.EXCHANGES)],
    ),
    "mkt": values_cte(
        "mkt",
        "idx, market_flag, directory_code, market, suffix",
        [(i, *row) for i, row in enumerate(dims.UNIVERSE_MARKETS)],
    ),
    "disp": values_cte("disp", "suffix, flag, sign, label", dims.DISPLAY),
    "ticks": f"""ticks AS (
        SELECT 'S' || l_suppkey || reg.suffix AS ticker, price_date,
               first(tick ORDER BY l_orderkey, l_linenumber, l_partkey, tick) AS o,
               max(tick) AS h, min(tick) AS l,
               last(tick ORDER BY l_orderkey, l_linenumber, l_partkey, tick) AS c,
               CAST(sum(l_quantity * 1000) AS BIGINT) AS v
        FROM (SELECT *, CAST(l_shipdate AS DATE) AS price_date,
                     CAST(round(l_extendedprice * 100) AS BIGINT) AS tick FROM lineitem) t
        JOIN reg ON reg.idx = l_suppkey % {N_EXCHANGES}
        GROUP BY l_suppkey, reg.suffix, price_date)""",
    "bars": """bars AS (
        SELECT ticker, price_date, o / 1e4 AS open, h / 1e4 AS high, l / 1e4 AS low,
               c / 1e4 AS close, v AS volume FROM ticks)""",
    "steps": """steps AS (
        SELECT *, row_number() OVER w AS n, lag(c) OVER w AS pc
        FROM ticks WINDOW w AS (PARTITION BY ticker ORDER BY price_date)),
        moves AS (
        SELECT *, greatest(coalesce(c - pc, 0), 0) AS gain, greatest(coalesce(pc - c, 0), 0) AS loss,
               greatest(h - l, coalesce(abs(h - pc), 0), coalesce(abs(l - pc), 0)) AS tr,
               l * 1000000 + datediff('day', DATE '1970-01-01', price_date) AS dated_low
        FROM steps)""",
    "panel": """sums AS (
        SELECT *,
          CAST(sum(gain) OVER (w ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS BIGINT) AS g14,
          CAST(sum(loss) OVER (w ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS BIGINT) AS l14,
          CAST(sum(tr) OVER (w ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS BIGINT) AS tr14,
          CAST(sum(c) OVER (w ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS BIGINT) AS c50,
          CAST(sum(c) OVER (w ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS BIGINT) AS c200,
          CAST(sum(v) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS BIGINT) AS v30,
          CAST(sum(v) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS BIGINT) AS v20,
          min(dated_low) OVER (w ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS low252,
          max(h) OVER (w ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS high252
        FROM moves WINDOW w AS (PARTITION BY ticker ORDER BY price_date)),
        panel AS (
        SELECT ticker, price_date, n AS n_bars, c / 1e4 AS price, v AS volume,
          (low252 // 1000000) / 1e4 AS low_52w, high252 / 1e4 AS high_52w,
          DATE '1970-01-01' + CAST(low252 % 1000000 AS INTEGER) AS low_date,
          datediff('day', DATE '1970-01-01', price_date) - low252 % 1000000 AS days_since_low,
          v30 / least(n, 30) AS avg_volume_30d,
          CASE WHEN v30 > 0 THEN v * least(n, 30) / v30 ELSE 0e0 END AS rvol,
          CASE WHEN n >= 20 THEN v20 / 2e1 ELSE CAST(v AS DOUBLE) END AS avg_volume_20d,
          CASE WHEN n < 15 THEN 5e1 WHEN g14 + l14 > 0 THEN 1e2 * g14 / (g14 + l14) END AS rsi,
          CASE WHEN n >= 50 THEN c50 / 5e5 ELSE c / 1e4 END AS sma50,
          CASE WHEN n >= 200 THEN c200 / 2e6 ELSE c / 1e4 END AS sma200,
          CASE WHEN n >= 50 THEN c * 50 / c50 ELSE 1e0 END AS price_vs_sma50_pct,
          (CASE WHEN n >= 50 THEN c50 ELSE c * 50 END) * 4
            / (CASE WHEN n >= 200 THEN c200 ELSE c * 200 END) AS sma50_vs_sma200_pct,
          CASE WHEN n < 15 THEN 5e-2 ELSE tr14 / (c * 14e0) END AS atr_pct
        FROM sums)""",
    "listings": f"""listings AS (
        SELECT 'supplier' AS kind, 'S' || s_suppkey || reg.suffix AS ticker, s_suppkey AS key,
               s_name AS name, s_nationkey AS nation, s_acctbal AS balance,
               CAST(NULL AS VARCHAR) AS segment, reg.exchange, reg.currency AS reg_currency
        FROM supplier JOIN reg ON reg.idx = s_suppkey % {N_EXCHANGES}
        UNION ALL
        SELECT 'customer', 'C' || c_custkey || reg.suffix, c_custkey, c_name, c_nationkey,
               c_acctbal, c_mktsegment, reg.exchange, reg.currency
        FROM customer JOIN reg ON reg.idx = c_custkey % {N_EXCHANGES})""",
    "tickers": """tickers AS (
        SELECT ticker, exchange AS market,
               CASE WHEN balance < 0 THEN 'INACTIVE' WHEN balance < 500 THEN NULL
                    WHEN balance >= 8000 THEN 'INACTIVE' ELSE 'ACTIVE' END AS status,
               CASE WHEN balance < 0 THEN 'negative balance' END AS status_message,
               TIMESTAMP '2001-11-05 00:00:00'
                 - to_days(CAST(floor(abs(balance) / 25) AS INTEGER)) AS last_updated
        FROM listings)""",
    "fundamentals": """fundamentals AS (
        SELECT ticker, upper(left(kind, 1)) || key AS symbol,
               CASE WHEN balance NOT BETWEEN 9000 AND 9500 THEN name END AS company_name,
               exchange, CAST(round(balance * 100) AS BIGINT) * 1000 AS market_cap_usd,
               CAST(CAST(round(balance * 100) AS BIGINT) * 1000 AS DOUBLE) AS mkt_cap_usd,
               segment AS sector, 'Industry ' || nation AS industry, reg_currency AS currency,
               'NATION_' || nation AS country,
               TIMESTAMP '2001-11-05 00:00:00'
                 - to_days(CAST(floor(abs(balance) / 25) AS INTEGER)) AS last_updated,
               kind AS data_source, balance >= 500 AS is_active,
               round(balance / 9 - 50, 2) AS pe_ratio, round(balance / 4000, 2) AS debt_to_equity,
               round(balance / 5000, 2) AS current_ratio,
               CASE WHEN balance < 7000 THEN round(balance / 50 + 1, 2) END AS xml_52w_low,
               round(balance / 10 + 5, 2) AS xml_52w_high
        FROM listings WHERE balance >= 0)""",
    "directory": f"""directory AS (
        SELECT 'P' || p_partkey || CASE WHEN p_size > 25 THEN mkt.suffix ELSE '' END AS ticker,
               p_name AS company_name, p_name || ', ' || p_type || ', ' || p_brand AS summary,
               p_brand AS sector, directory_code AS exchange, market,
               (SELECT reg.currency FROM reg WHERE reg.exchange = mkt.market) AS currency,
               CASE p_type WHEN 'ECONOMY' THEN 'Nano Cap' WHEN 'SMALL' THEN 'Micro Cap'
                    WHEN 'STANDARD' THEN 'Small Cap' WHEN 'MEDIUM' THEN 'Mid Cap'
                    WHEN 'LARGE' THEN 'Large Cap' END AS market_cap_category,
               p_partkey, p_size, p_retailprice, mkt.suffix AS market_suffix
        FROM part JOIN mkt ON mkt.idx = p_partkey % {N_MARKETS})""",
    "ev": f"""ev AS (
        SELECT event_id, event_type, user_id, ts, props, CAST(props->>'$.k' AS BIGINT) AS k,
               CAST(round(value * 100) AS BIGINT) AS cents,
               'C' || user_id || reg.suffix AS ticker
        FROM events JOIN reg ON reg.idx = user_id % {N_EXCHANGES})""",
    # raw quotes already typed: what parsing the documents must give back
    "quotes": """quotes AS (
        SELECT ticker,
               CASE WHEN event_type <> 'click' THEN cents / 1e2 ELSE (cents + k) / 1e2 END AS last_price,
               CASE WHEN event_type <> 'error' THEN (cents + k) / 1e2 END AS close_price,
               (cents + 2 * k) / 1e2 AS open_price, (cents + 3 * k) / 1e2 AS high_price,
               (cents - k) / 1e2 AS low_price, k * 1000 AS volume, ts AS last_updated, event_id
        FROM ev WHERE event_type <> 'signup')""",
    "latest": """latest AS (
        SELECT * FROM quotes
        QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY last_updated DESC, event_id DESC) = 1)""",
    "failures": """failures AS (
        SELECT event_id, ticker,
               CASE WHEN k < 25 THEN 'HTTP Error 404: page missing'
                    WHEN k < 50 THEN 'Possibly Delisted; no price data'
                    WHEN k < 60 THEN 'No data found for this date range'
                    ELSE 'Read timed out' END AS message,
               CASE WHEN k < 30 THEN 200 WHEN k < 50 THEN 354 WHEN k < 70 THEN 502
                    WHEN k < 90 THEN 504 ELSE 999 END AS error_code,
               k % 5 AS retry_count
        FROM ev WHERE event_type = 'error')""",
    "cache_entries": """cache_entries AS (
        SELECT md5(user_id || '|' || event_type) AS cache_key, props AS data, ts AS timestamp,
               event_type AS data_type, event_id FROM events)""",
}

_NEEDS = {
    "ticks": ("reg",),
    "bars": ("ticks",),
    "steps": ("ticks",),
    "panel": ("steps",),
    "listings": ("reg",),
    "tickers": ("listings",),
    "fundamentals": ("listings",),
    "directory": ("mkt", "reg"),
    "ev": ("reg",),
    "quotes": ("ev",),
    "latest": ("quotes",),
    "failures": ("ev",),
}


def sql(needs: str, body: str, extra: str = "") -> str:
    """A query body preceded by the adapters it needs, in dependency order."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for dependency in _NEEDS.get(name, ()):
            add(dependency)
        if name not in ordered:
            ordered.append(name)

    for name in needs.split():
        add(name)
    parts = [CTES[name] for name in ordered] + ([extra] if extra else [])
    prefix = "WITH " + ",\n".join(parts) + "\n" if parts else ""
    return prefix + body
