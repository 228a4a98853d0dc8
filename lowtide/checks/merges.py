"""Table state changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lowtide import dims
from lowtide.checks.base import query, sql
from lowtide.operators import buckets, exports, merge
from lowtide.operators.universe import validity
from lowtide.sources import benchmark_tables as tables
from lowtide.sources import json_docs
from lowtide.sources.benchmark_tables import EVENTS_TIME, LAST_DAY, UNIVERSE_TIME
from lowtide.session import run_folder

NOW = "TIMESTAMP '2001-11-05 00:00:00'"
TTL = {"view": 24, "click": 72, "error": 240, "purchase": 480}


def _incoming(spark, sf):
    """Directory listings as incoming tickers, known customers that moved, and known and new ones
    that state no market."""
    listed = tables.directory(spark, sf).select("ticker", "market")
    moved = (
        tables.listings(spark, sf)
        .filter(F.col("segment") == "MACHINERY")
        .select("ticker", F.lit("MOVED").alias("market"))
    )
    seen = (
        tables.listings(spark, sf)
        .filter(F.col("segment") == "BUILDING")
        .select(F.when(F.col("nation") < 5, F.concat(F.lit("X"), "ticker")).otherwise(F.col("ticker")).alias("ticker"))
        .withColumn("market", F.lit(None).cast("string"))
    )
    return listed.unionByName(moved).unionByName(seen)


@query(
    "upsert_keep_status",
    "K-2",
    sql(
        "tickers directory",
        f"""SELECT coalesce(t.ticker, i.ticker) AS ticker, coalesce(i.market, t.market) AS market,
                   CASE WHEN t.ticker IS NULL THEN 'ACTIVE' ELSE t.status END AS status, t.status_message,
                   CASE WHEN i.ticker IS NOT NULL THEN {NOW} ELSE t.last_updated END AS last_updated
            FROM tickers t FULL JOIN (
              SELECT ticker, market FROM directory
              UNION ALL SELECT ticker, 'MOVED' FROM listings WHERE segment = 'MACHINERY'
              UNION ALL SELECT CASE WHEN nation < 5 THEN 'X' || ticker ELSE ticker END, NULL
              FROM listings WHERE segment = 'BUILDING') i
            ON i.ticker = t.ticker""",
    ),
)
def upsert_keep_status(spark, sf):
    return merge.save_tickers(tables.tickers(spark, sf), _incoming(spark, sf), UNIVERSE_TIME)


@query(
    "upsert_all_columns",
    "K-3",
    sql(
        "fundamentals",
        """SELECT ticker, market_cap_usd + CASE WHEN sector = 'FURNITURE' THEN 7 ELSE 0 END AS market_cap_usd,
                  CASE WHEN sector = 'FURNITURE' THEN 'update' ELSE data_source END AS data_source
           FROM fundamentals
           UNION ALL SELECT 'N' || n_nationkey, CAST(n_regionkey AS BIGINT), 'update' FROM nation""",
    ),
)
def upsert_all_columns(spark, sf):
    current = tables.fundamentals(spark, sf).select(
        "ticker", "market_cap_usd", "data_source", "last_updated"
    )
    # the same key arrives twice; the newer copy must win
    change = tables.fundamentals(spark, sf).filter(F.col("sector") == "FURNITURE")
    step = lambda add, hours: change.select(
        "ticker",
        (F.col("market_cap_usd") + add).alias("market_cap_usd"),
        F.lit("update").alias("data_source"),
        (F.col("last_updated") + F.expr(f"interval {hours} hours")).alias("last_updated"),
    )
    fresh = tables.load(spark, sf, "nation").select(
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("ticker"),
        F.col("n_regionkey").cast("bigint").alias("market_cap_usd"),
        F.lit("update").alias("data_source"),
        F.lit(UNIVERSE_TIME).cast("timestamp_ntz").alias("last_updated"),
    )
    incoming = step(3, 1).unionByName(step(7, 2)).unionByName(fresh)
    return merge.upsert(current, incoming, ["ticker"], ["last_updated"]).drop("last_updated")


@query(
    "merge_guarded",
    "K-4",
    sql(
        "quotes",
        """SELECT ticker, last_price, volume, last_updated FROM quotes
           QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY last_updated DESC, event_id DESC) = 1""",
    ),
)
def merge_guarded(spark, sf):
    """Purchases are stored; all other quotes arrive, older and newer ones mixed."""
    events = tables.load(spark, sf, "events")
    purchase = F.col("event_type") == "purchase"
    stored = json_docs.latest_quotes(tables.raw_quotes_of(events.filter(purchase)), ["event_id"])
    arriving = json_docs.parse_quotes(tables.raw_quotes_of(events.filter(~purchase)))
    return merge.guarded_upsert(
        stored, arriving, ["ticker"], "last_updated", ["event_id"]
    ).select("ticker", "last_price", "volume", "last_updated")


@query(
    "insert_ignore_existing",
    "K-5",
    sql(
        "bars",
        """SELECT ticker, price_date, close FROM bars WHERE price_date > DATE '2001-06-30'""",
    ),
)
def insert_ignore_existing(spark, sf):
    bars = tables.bars(spark, sf).select("ticker", "price_date", "close")
    edge = F.lit("2001-06-30").cast("date")
    return merge.new_rows_only(bars.filter(F.col("price_date") <= edge), bars, ["ticker", "price_date"])


@query(
    "status_update",
    "K-6 P-16",
    sql(
        "tickers failures",
        f"""SELECT t.ticker, t.market,
              CASE WHEN n.ticker IS NOT NULL THEN n.status ELSE t.status END AS status,
              CASE WHEN n.ticker IS NOT NULL THEN n.message ELSE t.status_message END AS status_message,
              CASE WHEN n.ticker IS NOT NULL THEN {NOW} ELSE t.last_updated END AS last_updated
            FROM tickers t LEFT JOIN (
              SELECT ticker, message,
                     CASE WHEN message = 'Read timed out' THEN 'ACTIVE' ELSE 'INACTIVE' END AS status
              FROM failures QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY event_id DESC) = 1
              ) n ON n.ticker = t.ticker""",
    ),
)
def status_update(spark, sf):
    from lowtide.operators.universe import classify_failures

    # many tickers fail for good and by a mere time-out, in either order: the last one counts
    updates = classify_failures(tables.failures(spark, sf)).select(
        "event_id",
        "ticker",
        F.when(F.col("new_status") == "INACTIVE", "INACTIVE").otherwise("ACTIVE").alias("status"),
        F.col("message").alias("status_message"),
    )
    return merge.update_status(tables.tickers(spark, sf), updates, UNIVERSE_TIME, ["event_id"])


_VALID = """valid AS (
    SELECT t.ticker, coalesce(n, 0) >= 1 AS is_valid FROM tickers t LEFT JOIN (
      SELECT ticker, count(*) AS n FROM bars WHERE price_date BETWEEN DATE '2001-10-05' AND DATE '2001-11-04'
      GROUP BY ticker) b ON b.ticker = t.ticker)"""


def _validation(spark, sf):
    recent = validity(tables.tickers(spark, sf), tables.bars(spark, sf), LAST_DAY, quick=False)
    month = tables.bars(spark, sf).filter(
        F.col("price_date").between(F.lit("2001-10-05").cast("date"), F.lit(LAST_DAY).cast("date"))
    )
    return recent.select("ticker").join(
        month.groupBy("ticker").agg(F.count("*").alias("n")), "ticker", "left"
    ).select("ticker", (F.coalesce("n", F.lit(0)) >= 1).alias("is_valid"))


@query(
    "active_flags",
    "K-7",
    sql(
        "tickers bars",
        """SELECT t.ticker, CASE WHEN market = 'SEHK' THEN v.is_valid ELSE coalesce(status, '') <> 'INACTIVE' END
                  AS is_active FROM tickers t JOIN valid v USING (ticker)""",
        _VALID,
    ),
)
def active_flags(spark, sf):
    flagged = tables.tickers(spark, sf).withColumn(
        "is_active", F.coalesce("status", F.lit("")) != "INACTIVE"
    )
    return merge.set_active_flags(flagged, _validation(spark, sf), "SEHK").select("ticker", "is_active")


@query(
    "deactivate_stale",
    "K-8",
    sql(
        "fundamentals",
        f"""SELECT ticker, last_updated < {NOW} - INTERVAL 90 DAY AS was_marked,
                   CASE WHEN last_updated < {NOW} - INTERVAL 90 DAY THEN FALSE ELSE is_active END AS is_active
            FROM fundamentals""",
    ),
)
def deactivate_stale(spark, sf):
    return merge.deactivate_stale(tables.fundamentals(spark, sf), UNIVERSE_TIME).select(
        "ticker", "was_marked", "is_active"
    )


@query(
    "partial_update",
    "K-9",
    sql(
        "fundamentals",
        """SELECT ticker, company_name, CASE WHEN sector = 'BUILDING' THEN pe_ratio + 2 ELSE pe_ratio END AS pe_ratio,
                  CASE WHEN sector = 'BUILDING' THEN 'EUR' ELSE currency END AS currency FROM fundamentals""",
    ),
)
def partial_update(spark, sf):
    rows = tables.fundamentals(spark, sf)
    # every change arrives three times; the second one is the newest
    change = rows.filter(F.col("sector") == "BUILDING").select(
        "ticker",
        F.lit("EUR").alias("currency"),
        F.col("pe_ratio").alias("_pe"),
        F.explode(F.array(F.lit(1), F.lit(2), F.lit(0))).alias("round"),
    )
    change = change.withColumn("pe_ratio", F.col("_pe") + F.col("round"))
    current = rows.select("ticker", "company_name", "pe_ratio", "currency")
    return merge.update_columns(current, change, "ticker", ["pe_ratio", "currency"], ["round"])


@query(
    "reload_scope",
    "K-10",
    sql(
        "fundamentals",
        """SELECT ticker, CASE WHEN ticker LIKE '%.HK' THEN 'reloaded' ELSE data_source END AS data_source
           FROM fundamentals WHERE ticker NOT LIKE '%.HK' OR is_active""",
    ),
)
def reload_scope(spark, sf):
    rows = tables.fundamentals(spark, sf).select("ticker", "data_source", "is_active")
    hk = F.col("ticker").endswith(".HK")
    reloaded = rows.filter(hk & F.col("is_active")).withColumn("data_source", F.lit("reloaded"))
    return merge.reload_scope(rows, reloaded, hk).drop("is_active")


@query(
    "reload_partitions",
    "K-10",
    sql(
        "fundamentals",
        """SELECT ticker, CASE WHEN exchange = 'LSE' THEN 'reloaded' ELSE data_source END AS data_source, exchange
           FROM fundamentals WHERE exchange <> 'LSE' OR is_active""",
    ),
)
def reload_partitions(spark, sf):
    """The table is partitioned by exchange; only the reloaded partition is rewritten."""
    rows = tables.fundamentals(spark, sf).select("ticker", "data_source", "exchange", "is_active")
    folder = run_folder(spark, "partitions")
    merge.replace_partitions(rows.drop("is_active"), folder, ["exchange"])
    again = rows.filter((F.col("exchange") == "LSE") & F.col("is_active")).drop("is_active")
    merge.replace_partitions(again.withColumn("data_source", F.lit("reloaded")), folder, ["exchange"])
    return spark.read.schema("ticker string, data_source string, exchange string").parquet(folder)


@query(
    "replace_table",
    "K-3 K-13",
    sql(
        "latest",
        "SELECT ticker, last_price, CAST(2 AS BIGINT) AS generation FROM latest",
    ),
)
def replace_table(spark, sf):
    """A table is replaced by a state computed from itself."""
    folder = run_folder(spark, "replaced")
    first = json_docs.latest_quotes(tables.raw_quotes(spark, sf), ["event_id"])
    first = first.select("ticker", "last_price", F.lit(1).cast("bigint").alias("generation"))
    merge.replace_table(spark, first, folder)
    state = merge.read_current(spark, folder).withColumn("generation", F.col("generation") + 1)
    merge.replace_table(spark, state, folder)
    return merge.read_current(spark, folder)


@query(
    "drop_table",
    "K-13",
    sql("latest", "SELECT ticker, 'second' AS life FROM latest WHERE last_price > 100"),
)
def drop_table(spark, sf):
    """A table is written, dropped and created again with other rows."""
    folder = run_folder(spark, "dropped")
    rows = json_docs.latest_quotes(tables.raw_quotes(spark, sf), ["event_id"])
    merge.replace_table(spark, rows.select("ticker", F.lit("first").alias("life")), folder)
    merge.drop_table(spark, folder)
    assert merge.read_current(spark, folder) is None
    again = rows.filter("last_price > 100").select("ticker", F.lit("second").alias("life"))
    merge.replace_table(spark, again, folder)
    return merge.read_current(spark, folder)


@query(
    "ttl_expire",
    "K-11",
    sql(
        "cache_entries",
        """SELECT event_id, data_type, timestamp FROM cache_entries
           WHERE timestamp >= TIMESTAMP '2024-02-01' - to_hours(CASE data_type WHEN 'view' THEN 24
             WHEN 'click' THEN 72 WHEN 'error' THEN 240 WHEN 'purchase' THEN 480 ELSE 100000 END)""",
    ),
)
def ttl_expire(spark, sf):
    return merge.drop_expired(
        tables.cache_entries(spark, sf), dims.ttl_hours(spark, TTL), EVENTS_TIME
    ).select("event_id", "data_type", "timestamp")


@query(
    "repair_ids",
    "K-12",
    """SELECT CASE WHEN p_type = 'SMALL' THEN 'P' || p_partkey || '.NSE' ELSE 'P' || p_partkey || '.HK' END AS ticker,
              p_type FROM part WHERE p_type <> 'LARGE'""",
)
def repair_ids(spark, sf):
    bare = F.concat(F.lit("P"), F.col("p_partkey").cast("string"))
    kind = F.col("p_type")
    ending = F.when(kind == "SMALL", ".NS.NSE").when(kind == "LARGE", ".NSE").otherwise(".HK")
    return merge.repair_ids(
        tables.load(spark, sf, "part").select(F.concat(bare, ending).alias("ticker"), "p_type")
    )


@query(
    "fundamentals_export",
    "K-15 O-2",
    sql(
        "fundamentals",
        """SELECT ticker, symbol, exchange, CASE WHEN market_cap_usd <> 0 THEN format('{:,}', market_cap_usd) ELSE '' END
                  AS market_cap_usd, sector, industry, currency, country,
                  strftime(last_updated, '%Y-%m-%d') AS last_updated, data_source
           FROM fundamentals WHERE is_active""",
    ),
)
def fundamentals_export(spark, sf):
    return exports.fundamentals_export(tables.fundamentals(spark, sf))


@query(
    "review_export",
    "K-16 O-3",
    sql(
        "directory",
        """SELECT ticker, replace(summary, ',', ';') AS summary, coalesce(market_cap_category, '') AS market_cap_category
           FROM directory""",
    ),
)
def review_export(spark, sf):
    return exports.review_export(
        tables.directory(spark, sf),
        ["ticker", "summary", "market_cap_category"],
        ["market_cap_category", "ticker"],
    )


@query("ticker_export", "K-17", sql("directory", "SELECT ticker FROM directory"))
def ticker_export(spark, sf):
    return exports.ticker_export(tables.directory(spark, sf))


def _landing(spark, sf):
    """Raw rows with a flat quote document and a text document."""
    quotes = tables.load(spark, sf, "events").select(
        F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("ticker"),
        F.when(
            F.col("event_type") != "signup",
            F.to_json(
                F.struct(
                    F.col("value").alias("last"),
                    (F.col("value") - 1).alias("bid"),
                    (F.col("user_id") * 100).alias("volume"),
                    F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
                )
            ),
        ).alias("market_data"),
        F.col("props").alias("xml_snapshot"),
        F.col("ts").alias("last_updated"),
    )
    return quotes


@query(
    "split_raw_quotes",
    "K-18 F-16",
    """SELECT 'E' || event_id AS ticker, value AS last_price, value - 1 AS bid_price,
              CAST(NULL AS DOUBLE) AS ask_price, user_id * 100 AS volume, CAST(NULL AS BIGINT) AS avg_volume,
              date_trunc('second', ts) AS data_timestamp, ts AS last_updated
       FROM events WHERE event_type <> 'signup'""",
)
def split_raw_quotes(spark, sf):
    quotes, _ = merge.split_raw(_landing(spark, sf))
    return quotes.drop("market_data")


@query(
    "split_raw_documents",
    "K-18",
    "SELECT 'E' || event_id AS ticker, props AS xml_snapshot, ts AS last_updated FROM events",
)
def split_raw_documents(spark, sf):
    _, documents = merge.split_raw(_landing(spark, sf))
    return documents


@query(
    "cleanup_summary",
    "K-19 K-7",
    sql(
        "tickers bars",
        f"""SELECT 'SEHK' AS exchange, count(*) AS total_processed, count(*) FILTER (is_valid) AS valid_count,
                   count(*) FILTER (NOT is_valid) AS invalid_count, {NOW} AS cleaned_at, 'monthly' AS notes
            FROM valid""",
        _VALID,
    ),
)
def cleanup_summary(spark, sf):
    return merge.cleanup_summary(_validation(spark, sf), "SEHK", UNIVERSE_TIME, "monthly")


@query("merge_buckets", "K-3 K-4", sql("latest", "SELECT ticker, last_price, close_price, volume, last_updated FROM latest"))
def merge_buckets(spark, sf):
    """Quotes merged into a bucketed table in four changes, the newest first: older ones change nothing."""
    path = run_folder(spark, "buckets")
    rows = json_docs.parse_quotes(tables.raw_quotes(spark, sf))
    order = ["last_updated", "event_id"]
    part = lambda i: rows.filter(F.col("event_id") % 4 == i)
    buckets.create(part(3), path, ["ticker"], order, buckets=16)
    for i in (2, 1, 0):
        buckets.upsert(part(i), path, order, guard="last_updated")
    return buckets.read(spark, path).select("ticker", "last_price", "close_price", "volume", "last_updated")
