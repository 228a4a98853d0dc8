"""Aggregated reports, rankings and digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lowtide import dims
from lowtide.functions.rules import cache_key
from lowtide.functions.symbols import standardise
from lowtide.functions.text import alert_line, display_info


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table with its number of rows."""
    counts = [
        df.agg(F.lit(name).alias("table_name"), F.count("*").alias("row_count"))
        for name, df in tables.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), counts)


def standardise_counts(tables: dict[str, DataFrame], key: str = "ticker") -> DataFrame:
    """Per table: how many rows the ticker standardisation would change."""
    changed = standardise(F.col(key)) != F.col(key)
    counts = [
        df.agg(F.lit(name).alias("table_name"), F.count_if(changed).alias("changed_rows"))
        for name, df in tables.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), counts)


def latest_updates(bars: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """Newest bar day and newest fundamentals time."""
    days = bars.agg(F.max("price_date").alias("latest_price"))
    times = fundamentals.agg(F.max("last_updated").alias("latest_fundamentals"))
    return days.withColumn("latest_fundamentals", times.scalar())


def freshness(current: DataFrame, bars: DataFrame, asof, max_hours: int = 24) -> DataFrame:
    """Is the market data recent and is there any history?"""
    age = (
        F.timestamp_diff("SECOND", F.max("last_updated"), F.lit(asof).cast("timestamp_ntz")) / 3600.0
    )
    history = bars.agg(F.count("*"))
    summary = current.agg(
        F.count("*").alias("current_count"),
        F.max("last_updated").alias("latest_update"),
        F.round(age, 4).alias("hours_old"),
    ).withColumn("history_count", history.scalar())
    ok = (
        (F.col("current_count") > 0)
        & (F.col("history_count") > 0)
        & F.coalesce(F.col("hours_old") <= max_hours, F.lit(False))
    )
    return summary.withColumn("is_fresh", ok)


def market_freshness(tickers: DataFrame, asof, ttl_days: int = 7, min_count: int = 100) -> DataFrame:
    """Per market: enough tickers updated within the TTL?"""
    cutoff = F.lit(asof).cast("timestamp_ntz") - F.expr(f"interval {ttl_days} days")
    return (
        tickers.groupBy("market")
        .agg(F.count_if(F.col("last_updated") > cutoff).alias("recent"))
        .withColumn("is_fresh", F.col("recent") >= min_count)
    )


def market_cap_stats(fundamentals: DataFrame, exchange: str | None = None) -> DataFrame:
    """Count, average, extremes and bucket counts of active listings."""
    rows = fundamentals.filter(F.col("is_active"))
    if exchange is not None:
        rows = rows.filter(F.col("exchange") == exchange)
    cap = F.col("market_cap_usd")
    return rows.agg(
        F.count("*").alias("total_stocks"),
        # exact decimal sum: the average does not depend on the order of addition
        (F.sum(cap.cast("decimal(38,0)")).cast("double") / F.nullif(F.count(cap), F.lit(0))).alias(
            "avg_market_cap"
        ),
        F.min(cap).alias("min_market_cap"),
        F.max(cap).alias("max_market_cap"),
        F.count_if(cap < 100_000_000).alias("under_100m"),
        F.count_if(cap.between(100_000_000, 500_000_000)).alias("small_cap"),
        F.count_if(cap > 500_000_000).alias("mid_large_cap"),
    )


def below_threshold_stats(fundamentals: DataFrame, limit: int = 150_000_000) -> DataFrame:
    cap = F.col("market_cap_usd")
    return fundamentals.filter((cap > 0) & (cap < limit)).agg(
        F.count("*").alias("n"),
        F.min(cap).alias("min_cap"),
        F.max(cap).alias("max_cap"),
        (F.sum(cap.cast("decimal(38,0)")).cast("double") / F.nullif(F.count(cap), F.lit(0))).alias(
            "avg_cap"
        ),
    )


def source_breakdown(df: DataFrame, source: str, condition: Column) -> DataFrame:
    return df.groupBy(source).agg(
        F.count("*").alias("n"), F.count_if(condition).alias("n_matching")
    )


def completeness(df: DataFrame, first: str, second: str) -> DataFrame:
    """Rows that have one, the other, both or none of two payloads."""
    a, b = F.col(first).isNotNull(), F.col(second).isNotNull()
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(a).alias("has_first"),
        F.count_if(b).alias("has_second"),
        F.count_if(a & b).alias("has_both"),
        F.count_if(~a & ~b).alias("has_neither"),
        F.count_if(a & ~b).alias("only_first"),
        F.count_if(~a & b).alias("only_second"),
    )


def group_counts(df: DataFrame, *keys: str, drop_null: bool = False) -> DataFrame:
    """Rows per group; a report orders them once, at its end."""
    rows = df.dropna(subset=list(keys)) if drop_null else df
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def category_share(df: DataFrame, category: str, digits: int = 1) -> DataFrame:
    """Count and percentage per category; the total is a window over the counts, a row a category."""
    counts = (
        df.filter(F.col(category).isNotNull()).groupBy(category).agg(F.count("*").alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("pct", F.round(F.col("n") * 100.0 / total, digits))


def missing_audit(tables: list[tuple[str, DataFrame, Column]]) -> DataFrame:
    """Per table: rows, rows with a missing value, percentage."""
    parts = [
        df.agg(
            F.lit(name).alias("table_name"),
            F.count("*").alias("total_records"),
            F.count_if(missing).alias("missing"),
        )
        for name, df, missing in tables
    ]
    return reduce(lambda a, b: a.unionByName(b), parts).withColumn(
        "pct_missing",
        F.round(F.try_divide(F.col("missing") * F.lit(100.0), F.col("total_records")), 2),
    )


def success_rate(df: DataFrame, ok: Column) -> DataFrame:
    return df.agg(F.count("*").alias("processed"), F.count_if(ok).alias("succeeded")).withColumn(
        "rate_pct",
        F.round(F.try_divide(F.col("succeeded") * F.lit(100.0), F.col("processed")), 1),
    )


def distinct_in_order(df: DataFrame, key: str, position: Column) -> DataFrame:
    """Distinct keys with the position where each was first seen."""
    return df.groupBy(key).agg(F.min(position).alias("first_seen"))


def bars_per_ticker(bars: DataFrame) -> DataFrame:
    """Average number of bars; counted per ticker first, so a hot ticker is one small row."""
    per_ticker = bars.groupBy("ticker").agg(F.count("*").alias("n"))
    return per_ticker.agg(
        F.sum("n").cast("bigint").alias("bars"),
        F.count("*").alias("tickers"),
        (F.sum("n") / F.count("*")).alias("bars_per_ticker"),
    )


def digest(catches: DataFrame) -> DataFrame:
    """Digest rows: one header per exchange label with its count, then one line per catch.

    Lines are rows, not one collected text: an exchange may hold most of the catches.  Sort
    by (label, line_kind, ticker, price_date) and write as text to get the message.  Catches
    are read twice, so pass a written table rather than a pending screen.
    """
    rows = catches.withColumn("_d", display_info(F.col("symbol")))
    lines = rows.select(
        F.col("_d.label").alias("label"),
        F.lit(1).cast("bigint").alias("line_kind"),
        F.col("symbol").alias("ticker"),
        "price_date",
        alert_line(*[F.col(c) for c in ("symbol", "price", "pct_from_low", "rvol", "rsi", "atr_pct")]).alias(
            "line"
        ),
    )
    headers = (
        rows.groupBy("_d.flag", "_d.label")
        .agg(F.count("*").alias("n"))
        .select(
            "label",
            F.lit(0).cast("bigint").alias("line_kind"),
            F.lit("").alias("ticker"),
            F.lit(None).cast("date").alias("price_date"),
            F.concat(
                F.col("flag"), F.lit(" *"), F.col("label"), F.lit(" ("), F.col("n"), F.lit(")*")
            ).alias("line"),
        )
    )
    return headers.unionByName(lines)


def digest_title(catches: DataFrame) -> DataFrame:
    n = F.count("*")
    return catches.agg(
        F.concat(
            F.lit("📊 *DAILY SCAN — "),
            n.cast("string"),
            F.lit(" SIGNAL"),
            F.when(n > 1, "S").otherwise(""),
            F.lit("*"),
        ).alias("title")
    )


def markets_by_region(spark: SparkSession, flags: dict[str, bool] | None = None) -> DataFrame:
    """Enabled markets per region; a dimension-sized result."""
    enabled = dims.market_flags(spark, flags).filter("enabled")
    return (
        enabled.join(F.broadcast(dims.regions(spark)), "market_flag")
        .groupBy("region")
        .agg(F.array_sort(F.collect_set("market_flag")).alias("markets"))
    )


def cache_age(entries: DataFrame, asof) -> DataFrame:
    seconds = F.timestamp_diff("SECOND", F.col("timestamp"), F.lit(asof).cast("timestamp_ntz"))
    hours = lambda c: F.round(c / 3600.0, 4)
    return entries.agg(
        F.count("*").alias("entries"),
        hours(F.sum(seconds) / F.count("*")).alias("avg_age_hours"),
        hours(F.max(seconds)).alias("max_age_hours"),
        hours(F.min(seconds)).alias("min_age_hours"),
    )


def document_sizes(raw: DataFrame, documents: list[str], flag: str) -> DataFrame:
    """Bytes of all documents and how many rows have them."""
    size = sum((F.coalesce(F.length(d), F.lit(0)) for d in documents), F.lit(0))
    return raw.agg(
        F.count("*").alias("n"),
        F.sum(size).cast("bigint").alias("total_size"),
        F.count_if(F.col(documents[0]).isNotNull()).alias("has_document"),
        F.count_if(F.col(flag).isNotNull()).alias(f"has_{flag}"),
    )


def top_per_category(
    df: DataFrame, category: str, order: list[str], categories: int = 3, rows: int = 5
) -> DataFrame:
    """First rows by ``order`` within each of the largest categories.

    The rank limit is applied on the map side too (window group limit), so a category
    holding most rows ships only a few per task.
    """
    sizes = df.filter(F.col(category).isNotNull()).groupBy(category).agg(F.count("*").alias("size"))
    largest = sizes.orderBy(F.desc("size"), category).limit(categories)
    ranked = df.join(F.broadcast(largest), category).withColumn(
        "rn", F.row_number().over(Window.partitionBy(category).orderBy(*order))
    )
    return ranked.filter(F.col("rn") <= rows)


def nearest_to_low(rows: DataFrame, k: int = 10) -> DataFrame:
    return rows.orderBy("pct_from_low", "ticker").limit(k)


def hashed_sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """A repeatable random sample: the n smallest keyed hashes."""
    return df.orderBy(cache_key(F.col(key), F.lit(seed)), key).limit(n)


def capped(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in a fixed order (universe cap, resume limit)."""
    return df.orderBy(*order).limit(n)
