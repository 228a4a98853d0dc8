"""Data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from lowtide.checks.base import query, sql
from lowtide.operators import outliers, quality
from lowtide.sources import benchmark_tables as tables
from lowtide.sources.benchmark_tables import UNIVERSE_TIME
from lowtide.sources.json_docs import parse_quotes


def _parsed(spark, sf):
    return parse_quotes(tables.raw_quotes(spark, sf))


@query(
    "table_profile",
    "Q-A",
    sql(
        "tickers fundamentals",
        """SELECT 'lowtide_q_tickers' AS table_name, TRUE AS table_exists, count(*) AS row_count,
                  5 AS columns, CAST(NULL AS VARCHAR) AS issue FROM tickers
           UNION ALL SELECT 'lowtide_q_fundamentals', TRUE, count(*), 18, NULL FROM fundamentals
           UNION ALL SELECT 'lowtide_q_absent', FALSE, 0, 0, 'table not found'""",
    ),
)
def table_profile(spark, sf):
    tables.tickers(spark, sf).createOrReplaceTempView("lowtide_q_tickers")
    tables.fundamentals(spark, sf).createOrReplaceTempView("lowtide_q_fundamentals")
    return quality.table_profile(
        spark, ["lowtide_q_tickers", "lowtide_q_fundamentals", "lowtide_q_absent"]
    )


@query(
    "integrity_report",
    "Q-B J-2 J-3",
    sql(
        "bars latest fundamentals",
        """SELECT check_name, orphans, CASE WHEN orphans > 0 THEN 'issues_found' ELSE 'healthy' END AS status FROM (
             SELECT 'price_records' AS check_name, count(*) AS orphans FROM bars ANTI JOIN fundamentals USING (ticker)
             UNION ALL SELECT 'current_market_records', count(*) FROM latest ANTI JOIN fundamentals USING (ticker))""",
    ),
)
def integrity_report(spark, sf):
    from lowtide.checks.joins import latest

    return quality.integrity_report(
        tables.bars(spark, sf), latest(spark, sf), tables.fundamentals(spark, sf)
    )


def _rules_sql(source: str, rules: dict[str, str]) -> str:
    return "\nUNION ALL ".join(
        f"""SELECT '{name}' AS rule, count(*) AS rows_checked, count(*) FILTER ({broken}) AS invalid,
                   count(*) FILTER (({broken}) IS NULL) AS undecided FROM {source}"""
        for name, broken in rules.items()
    )


_FLAWED = """flawed AS (
    SELECT ticker, price_date, open, CASE WHEN volume > 40000 THEN low - 1 ELSE high END AS high, low,
           CASE WHEN volume < 2000 THEN 0e0 ELSE close END AS close,
           CASE WHEN volume = 25000 THEN -volume ELSE volume END AS volume FROM bars)"""
_BAR_RULES = {
    "price_out_of_range": "close < 1e-2 OR close > 100000",
    "negative_volume": "volume < 0",
    "bad_ohlc": "high < low OR high < open OR high < close OR low > open OR low > close",
}


def _flawed(spark, sf):
    """Bars with flaws that depend on their volume."""
    volume = F.col("volume")
    return (
        tables.bars(spark, sf)
        .withColumn("high", F.when(volume > 40_000, F.col("low") - 1).otherwise(F.col("high")))
        .withColumn("close", F.when(volume < 2_000, 0.0).otherwise(F.col("close")))
        .withColumn("volume", F.when(volume == 25_000, -volume).otherwise(volume))
    )


@query("bar_quality", "Q-C", sql("bars", _rules_sql("flawed", _BAR_RULES), _FLAWED))
def bar_quality(spark, sf):
    return quality.count_violations(_flawed(spark, sf), quality.bar_rules())


@query(
    "bar_quality_by_ticker",
    "Q-C",
    sql(
        "bars",
        f"""SELECT ticker, NOT (a OR b OR c) AS is_valid, concat_ws('; ',
              CASE WHEN a THEN 'Price range outside reasonable bounds' END,
              CASE WHEN b THEN 'Negative volume values found' END,
              CASE WHEN c THEN 'Invalid OHLC relationships' END) AS problems
            FROM (SELECT ticker, {", ".join(f"bool_or({r}) AS {n}" for n, r in zip("abc", _BAR_RULES.values()))}
                  FROM flawed GROUP BY ticker)""",
        _FLAWED,
    ),
)
def bar_quality_by_ticker(spark, sf):
    return quality.ticker_validity(_flawed(spark, sf))


@query(
    "valid_bars",
    "Q-C Q-G",
    sql(
        "bars",
        "SELECT ticker, price_date FROM flawed WHERE NOT ("
        + " OR ".join(f"({r})" for r in _BAR_RULES.values())
        + ")",
        _FLAWED,
    ),
)
def valid_bars(spark, sf):
    good, _ = quality.valid_rows(_flawed(spark, sf), quality.bar_rules())
    return good.select("ticker", "price_date")


@query(
    "quote_quality",
    "Q-D",
    sql(
        "quotes",
        _rules_sql(
            "quotes",
            {
                "no_price": "coalesce(last_price, 0) <= 0",
                "negative_volume": "coalesce(volume, 0) < 0",
                "high_below_low": "high_price <> 0 AND low_price <> 0 AND high_price < low_price",
            },
        ),
    ),
)
def quote_quality(spark, sf):
    return quality.count_violations(_parsed(spark, sf), quality.quote_rules())


@query(
    "fundamentals_quality",
    "Q-E",
    sql(
        "fundamentals",
        _rules_sql(
            "fundamentals",
            {
                "cap_not_positive": "NOT market_cap_usd > 0",
                "name_missing": "company_name IS NULL",
                "pe_out_of_range": "NOT pe_ratio BETWEEN 0 AND 1000",
            },
        ),
    ),
)
def fundamentals_quality(spark, sf):
    return quality.count_violations(tables.fundamentals(spark, sf), quality.fundamentals_rules())


@query(
    "constraints",
    "Q-G",
    sql(
        "fundamentals tickers latest",
        _rules_sql(
            "joined",
            {
                "cap_unreasonable": "NOT market_cap_usd BETWEEN 1000000 AND 10000000000000",
                "unknown_status": "status NOT IN ('ACTIVE', 'INACTIVE')",
                "price_not_positive": "NOT (last_price > 0 AND close_price > 0)",
            },
        ),
        """joined AS (SELECT t.ticker, status, market_cap_usd, last_price, close_price FROM tickers t
             LEFT JOIN fundamentals f ON f.ticker = t.ticker LEFT JOIN latest q ON q.ticker = t.ticker)""",
    ),
)
def constraints(spark, sf):
    from lowtide.checks.joins import latest

    joined = (
        tables.tickers(spark, sf)
        .select("ticker", "status")
        .join(tables.fundamentals(spark, sf).select("ticker", "market_cap_usd"), "ticker", "left")
        .join(latest(spark, sf).select("ticker", "last_price", "close_price"), "ticker", "left")
    )
    return quality.count_violations(joined, quality.constraint_rules())


@query(
    "quality_metrics",
    "Q-H",
    sql(
        "quotes",
        """SELECT 'quotes' AS table_name, sum(n) AS total_records, sum(nulls) AS null_values,
                  sum(n) - count(*) AS duplicate_records, sum(outliers) AS outlier_records,
                  round(1 - sum(nulls) / (sum(n) * 8e0), 6) AS completeness_score,
                  round(sum(timely) / sum(n), 6) AS timeliness_score
           FROM (SELECT ticker, count(*) AS n, sum(CAST(close_price IS NULL AS INT)) AS nulls,
                        count(*) FILTER (last_price > 100) AS outliers,
                        count(*) FILTER (last_updated >= TIMESTAMP '2024-02-01' - INTERVAL 10 DAY) AS timely
                 FROM quotes GROUP BY ticker)""",
    ),
)
def quality_metrics(spark, sf):
    return quality.quality_metrics(
        _parsed(spark, sf), "quotes", ["ticker"], "last_updated", tables.EVENTS_TIME,
        F.col("last_price") > 100, max_age_days=10,
    )


@query(
    "null_counts",
    "Q-H A-13",
    sql(
        "tickers",
        "\nUNION ALL ".join(
            f"SELECT '{c}' AS field_name, count(*) - count({c}) AS null_values FROM tickers"
            for c in ("ticker", "market", "status", "status_message", "last_updated")
        ),
    ),
)
def null_counts(spark, sf):
    return quality.null_counts(tables.tickers(spark, sf))


NUMBERS = ["last_price", "close_price", "volume"]


@query(
    "quality_outliers",
    "Q-H",
    sql(
        "quotes",
        " UNION ALL ".join(
            f"""SELECT t.ticker AS group_value, '{c}' AS column_name, count(*) AS "rows", CAST(q1 AS DOUBLE) AS q1, CAST(q3 AS DOUBLE) AS q3,
                       q1 - (q3 - q1) * 15e-1 AS low_limit, q3 + (q3 - q1) * 15e-1 AS high_limit,
                       count(*) FILTER (v < q1 - (q3 - q1) * 15e-1 OR v > q3 + (q3 - q1) * 15e-1) AS outliers
                FROM (SELECT *, CAST({c} AS DOUBLE) AS v FROM quotes WHERE {c} IS NOT NULL) t
                JOIN (SELECT ticker, list_sort(list(CAST({c} AS DOUBLE)))[CAST(ceil(count(*) * 25e-2) AS BIGINT)] AS q1,
                             list_sort(list(CAST({c} AS DOUBLE)))[CAST(ceil(count(*) * 75e-2) AS BIGINT)] AS q3
                      FROM quotes WHERE {c} IS NOT NULL GROUP BY ticker) q ON q.ticker = t.ticker
                GROUP BY t.ticker, q1, q3"""
            for c in NUMBERS
        ),
    ),
)
def quality_outliers(spark, sf):
    """Outliers of each ticker's quotes by limits learned from them."""
    return outliers.outliers(_parsed(spark, sf), "ticker", NUMBERS)
