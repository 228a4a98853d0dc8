"""CSV sinks.  Files are written by the tasks, one part per partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lowtide.functions.text import thousands
from lowtide.sources.tables import key_set


def catch_rows(catches: DataFrame, now) -> DataFrame:
    """Catches in log form: fixed columns, rounded, with defaults."""
    optional = lambda c, default: (
        F.coalesce(F.col(c), F.lit(default)) if c in catches.columns else F.lit(default)
    )
    name = "ticker" if "ticker" in catches.columns else "symbol"
    stamp = F.lit(now).cast("timestamp_ntz")
    return catches.select(
        (F.coalesce("timestamp", stamp) if "timestamp" in catches.columns else stamp).alias("timestamp"),
        F.coalesce(F.col(name), F.lit("UNKNOWN")).alias("ticker"),
        F.round(optional("price", 0.0), 2).alias("price"),
        optional("volume", 0).cast("bigint").alias("volume"),
        F.round(optional("usd_mcap", 0.0), 2).alias("usd_mcap"),
        F.round(optional("pct_from_low", 0.0), 4).alias("pct_from_low"),
        optional("reason", "").alias("reason"),
    )


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("quoteAll", False).csv(path)


def log_catches(catches: DataFrame, path: str, now) -> None:
    write_csv(catch_rows(catches, now), path, mode="append")


def fundamentals_export(fundamentals: DataFrame) -> DataFrame:
    """Active listings, largest first, with readable numbers and dates."""
    cap = F.col("market_cap_usd")
    return (
        fundamentals.filter("is_active")
        .orderBy(F.desc_nulls_last("market_cap_usd"), "ticker")
        .select(
            "ticker",
            "symbol",
            "exchange",
            F.when(cap != 0, thousands(cap)).otherwise("").alias("market_cap_usd"),
            "sector",
            "industry",
            "currency",
            "country",
            F.coalesce(F.date_format("last_updated", "yyyy-MM-dd"), F.lit("")).alias("last_updated"),
            "data_source",
        )
    )


def review_export(directory: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """Listings for manual review: no commas inside values, no NULLs."""
    cleaned = [
        F.coalesce(F.translate(F.col(c).cast("string"), ",", ";"), F.lit("")).alias(c)
        for c in columns
    ]
    return directory.orderBy(*order).select(*cleaned)


def ticker_export(df: DataFrame) -> DataFrame:
    return key_set(df)


def write_digest(digest: DataFrame, path: str) -> None:
    """Digest rows as ordered text files."""
    ordered = digest.orderBy("label", "line_kind", "ticker", "price_date")
    ordered.select("line").write.mode("overwrite").text(path)
