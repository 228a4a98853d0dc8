"""Data quality: profiles, integrity, validity rules, constraints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lowtide.operators.lookups import orphan_count


def table_profile(spark: SparkSession, names: list[str]) -> DataFrame:
    """Existence, row count and number of columns of registered tables, with issues."""
    parts = []
    for name in names:
        if spark.catalog.tableExists(name):
            df = spark.table(name)
            parts.append(
                df.agg(
                    F.lit(name).alias("table_name"),
                    F.lit(True).alias("table_exists"),
                    F.count("*").alias("row_count"),
                    F.lit(len(df.columns)).cast("bigint").alias("columns"),
                    F.when(F.count("*") == 0, "empty table").alias("issue"),
                )
            )
        else:
            parts.append(
                spark.range(1).select(
                    F.lit(name).alias("table_name"),
                    F.lit(False).alias("table_exists"),
                    F.lit(0).cast("bigint").alias("row_count"),
                    F.lit(0).cast("bigint").alias("columns"),
                    F.lit("table not found").alias("issue"),
                )
            )
    return reduce(lambda a, b: a.unionByName(b), parts)


def integrity_report(bars: DataFrame, current: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """Orphaned rows per table and a status."""
    parts = [
        orphan_count(df, fundamentals).withColumn("check_name", F.lit(name))
        for name, df in (("price_records", bars), ("current_market_records", current))
    ]
    return parts[0].unionByName(parts[1]).withColumn(
        "status", F.when(F.col("orphans") > 0, "issues_found").otherwise("healthy")
    )


# --- rules -----------------------------------------------------------------------------------


def bar_rules() -> dict[str, Column]:
    """True where a bar violates the rule."""
    high, low, open_, close = (F.col(c) for c in ("high", "low", "open", "close"))
    return {
        "price_out_of_range": (close < 0.01) | (close > 100_000),
        "negative_volume": F.col("volume") < 0,
        "bad_ohlc": (high < low) | (high < open_) | (high < close) | (low > open_) | (low > close),
    }


def quote_rules() -> dict[str, Column]:
    last, volume = F.coalesce("last_price", F.lit(0.0)), F.coalesce("volume", F.lit(0))
    high, low = F.col("high_price"), F.col("low_price")
    return {
        "no_price": last <= 0,
        "negative_volume": volume < 0,
        "high_below_low": (high != 0) & (low != 0) & (high < low),
    }


def fundamentals_rules() -> dict[str, Column]:
    return {
        "cap_not_positive": ~(F.col("market_cap_usd") > 0),
        "name_missing": F.col("company_name").isNull(),
        "pe_out_of_range": ~F.col("pe_ratio").between(0, 1000),
    }


def constraint_rules() -> dict[str, Column]:
    return {
        "cap_unreasonable": ~F.col("market_cap_usd").between(1_000_000, 10_000_000_000_000),
        "unknown_status": ~F.col("status").isin("ACTIVE", "INACTIVE"),
        "price_not_positive": ~((F.col("last_price") > 0) & (F.col("close_price") > 0)),
    }


def count_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Per rule: violations, and rows where the rule is undecided because of a NULL."""
    aggregates = [F.count("*").alias("_n")]
    for name, broken in rules.items():
        aggregates += [
            F.count_if(broken).alias(f"_bad_{name}"),
            F.count_if(broken.isNull()).alias(f"_null_{name}"),
        ]
    counts = df.agg(*aggregates)
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("rule"),
                F.col("_n").alias("rows_checked"),
                F.col(f"_bad_{name}").alias("invalid"),
                F.col(f"_null_{name}").alias("undecided"),
            )
            for name in rules
        ]
    )
    return counts.select(F.inline(rows))


def valid_rows(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Split into rows that break no rule and rows with the list of broken rules."""
    broken = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    judged = df.withColumn("broken_rules", broken)
    return (
        judged.filter(F.size("broken_rules") == 0).drop("broken_rules"),
        judged.filter(F.size("broken_rules") > 0),
    )


def ticker_validity(bars: DataFrame) -> DataFrame:
    """Per ticker: which validations of its bars failed."""
    flags = {name: F.bool_or(F.coalesce(c, F.lit(False))).alias(name) for name, c in bar_rules().items()}
    # fixed values: output texts
    messages = {
        "price_out_of_range": "Price range outside reasonable bounds",
        "negative_volume": "Negative volume values found",
        "bad_ohlc": "Invalid OHLC relationships",
    }
    found = F.array_compact(F.array(*[F.when(F.col(n), F.lit(m)) for n, m in messages.items()]))
    return (
        bars.groupBy("ticker")
        .agg(*flags.values())
        .select("ticker", (F.size(found) == 0).alias("is_valid"), F.array_join(found, "; ").alias("problems"))
    )


def quality_metrics(
    df: DataFrame, name: str, key: list[str], time: str, asof, outlier: Column, max_age_days: int = 30
) -> DataFrame:
    """Completeness, duplicates, outliers and timeliness of a table as one row.

    Duplicates are counted from per-key counts, so repeated keys are combined before the
    shuffle.
    """
    fields = [c for c in df.columns if c not in key]
    cutoff = F.lit(asof).cast("timestamp_ntz") - F.expr(f"interval {max_age_days} days")
    nulls = sum((F.count_if(F.col(c).isNull()) for c in fields), F.lit(0))
    per_key = df.groupBy(*key).agg(
        F.count("*").alias("_n"),
        nulls.alias("_nulls"),
        F.count_if(outlier).alias("_outliers"),
        F.count_if(F.col(time).cast("timestamp_ntz") >= cutoff).alias("_timely"),
    )
    total = F.sum("_n")
    return per_key.agg(
        F.lit(name).alias("table_name"),
        total.cast("bigint").alias("total_records"),
        F.sum("_nulls").cast("bigint").alias("null_values"),
        (total - F.count("*")).cast("bigint").alias("duplicate_records"),
        F.sum("_outliers").cast("bigint").alias("outlier_records"),
        F.round(1 - F.sum("_nulls") / (total * F.lit(float(max(len(fields), 1)))), 6).alias(
            "completeness_score"
        ),
        F.round(F.sum("_timely") / total, 6).alias("timeliness_score"),
    )


def null_counts(df: DataFrame) -> DataFrame:
    """Number of NULLs per column."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "field_name", "null_values")
