"""Sources: parameterised SQL, lists, wide tables, catch logs, landing."""

from __future__ import annotations

from pyspark.sql import functions as F

from lowtide import schemas
from lowtide.checks.base import query, sql
from lowtide.operators.exports import log_catches, write_csv
from lowtide.sources import benchmark_tables as tables
from lowtide.sources import tables as readers
from lowtide.session import run_folder


@query(
    "parameterised_sql",
    "S-1",
    sql(
        "fundamentals",
        """SELECT exchange, count(*) AS n, max(market_cap_usd) AS largest FROM fundamentals
           WHERE market_cap_usd >= 200000000 AND sector = 'MACHINERY' GROUP BY exchange""",
    ),
)
def parameterised_sql(spark, sf):
    tables.fundamentals(spark, sf).createOrReplaceTempView("lowtide_fundamentals")
    return readers.parameterised_query(
        spark,
        """SELECT exchange, count(*) AS n, max(market_cap_usd) AS largest FROM lowtide_fundamentals
           WHERE market_cap_usd >= :floor AND sector = :sector GROUP BY exchange""",
        {"floor": 200_000_000, "sector": "MACHINERY"},
    )


@query(
    "ticker_lists",
    "S-2",
    sql(
        "listings",
        """SELECT exchange, kind || ' ' || key // 500 AS index_name, ticker,
                  row_number() OVER (PARTITION BY exchange, kind, key // 500 ORDER BY ticker) - 1 AS position
           FROM listings""",
    ),
)
def ticker_lists(spark, sf):
    """Lists of one exchange and a block of 500 keys each are written, then read back."""
    block = F.concat_ws(" ", "kind", F.floor(F.col("key") / 500).cast("string"))
    lists = (
        tables.listings(spark, sf)
        .groupBy("exchange", block.alias("index_name"))
        .agg(F.array_sort(F.collect_list("ticker")).alias("tickers"))
    )
    folder = run_folder(spark, "lists")
    lists.write.json(folder)
    return readers.ticker_lists(spark, folder, one_document_per_file=False).select(
        "exchange", "index_name", "ticker", F.col("position").cast("bigint").alias("position")
    )


@query(
    "directory_search",
    "S-5",
    sql("directory", "SELECT ticker, company_name FROM directory WHERE exchange = 'HKG'"),
)
def directory_search(spark, sf):
    return readers.directory_search(tables.directory(spark, sf), "HKG").select(
        "ticker", "company_name"
    )


_WIDE = """
    flags AS (
        SELECT l_returnflag AS ticker, CAST(l_shipdate AS DATE) AS price_date,
               first(tick ORDER BY l_orderkey, l_linenumber, l_partkey, tick, l_suppkey) / 1e4 AS open,
               max(tick) / 1e4 AS high, min(tick) / 1e4 AS low,
               last(tick ORDER BY l_orderkey, l_linenumber, l_partkey, tick, l_suppkey) / 1e4 AS close,
               CAST(sum(l_quantity * 1000) AS BIGINT) AS volume
        FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS tick FROM lineitem)
        GROUP BY ALL),
    days AS (SELECT DISTINCT price_date FROM flags),
    grid AS (SELECT ticker, price_date FROM (SELECT DISTINCT ticker FROM flags) JOIN days ON TRUE)"""


@query(
    "wide_to_bars",
    "S-6",
    sql(
        "",
        """SELECT ticker, price_date, open, high, low, close, coalesce(volume, 0) AS volume
           FROM grid LEFT JOIN flags USING (ticker, price_date)""",
        _WIDE.strip(),
    ),
)
def wide_to_bars(spark, sf):
    return readers.wide_to_bars(tables.wide_bars(spark, sf))


@query(
    "ingest_wide",
    "S-7",
    sql("", "SELECT *, 'wide' AS source FROM flags", _WIDE.strip()),
)
def ingest_wide(spark, sf):
    return readers.ingest_wide(tables.wide_bars(spark, sf), "wide")


@query(
    "catch_log_readback",
    "S-8 K-14",
    sql(
        "bars",
        """SELECT ticker, (CAST(close * 1e4 AS BIGINT) + 50) // 100 / 1e2 AS price, volume,
                  'bar' AS reason FROM bars""",
    ),
)
def catch_log_readback(spark, sf):
    """Two appends to the log, then a read with the fixed schema."""
    rows = tables.bars(spark, sf).select(
        F.col("ticker").alias("symbol"), F.col("close").alias("price"), "volume", "price_date",
        F.lit("bar").alias("reason"),
    )
    folder, edge = run_folder(spark, "catches"), F.lit("2001-10-01").cast("date")
    log_catches(rows.filter(F.col("price_date") < edge), folder, tables.UNIVERSE_TIME)
    log_catches(rows.filter(F.col("price_date") >= edge), folder, tables.UNIVERSE_TIME)
    return readers.read_catches(spark, folder).select("ticker", "price", "volume", "reason")


@query(
    "catch_log_malformed",
    "S-8",
    sql(
        "bars",
        """SELECT 'kept' AS state, count(*) AS lines, CAST(sum(volume) AS BIGINT) AS volume FROM bars
           UNION ALL SELECT 'quarantined', count(*), CAST(sum(length(ticker)) AS BIGINT) FROM bars
           WHERE day(price_date) = 1""",
    ),
)
def catch_log_malformed(spark, sf):
    """A log in another column order, with a bad copy of every bar of a first of the month."""
    rows = tables.bars(spark, sf).select(
        F.lit("bar").alias("reason"), F.col("volume").cast("string").alias("volume"), F.col("close").alias("price"),
        "ticker", "price_date",
    )
    first = rows.filter(F.dayofmonth("price_date") == 1)
    bad = first.withColumn("volume", F.concat(F.lit("about "), F.col("volume")))
    folder = run_folder(spark, "catches")
    write_csv(rows.unionByName(bad).drop("price_date"), folder)
    kept, quarantined = readers.read_catches(spark, folder), readers.malformed_catches(spark, folder)
    return kept.agg(
        F.lit("kept").alias("state"), F.count("*").alias("lines"), F.sum("volume").alias("volume")
    ).unionByName(
        quarantined.agg(
            F.lit("quarantined").alias("state"),
            F.count("*").alias("lines"),
            F.sum(F.length(F.col("fields")["ticker"])).cast("bigint").alias("volume"),
        )
    )


@query(
    "raw_landing",
    "S-9 K-1",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value, event_type
       FROM events""",
)
def raw_landing(spark, sf):
    folder = run_folder(spark, "landing")
    rows = tables.load(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value")).alias("value"),
        "event_type",
    )
    readers.land_raw(rows, folder)
    return spark.read.parquet(folder)


@query("key_set", "S-10", sql("fundamentals", "SELECT ticker FROM fundamentals ORDER BY ticker"))
def key_set(spark, sf):
    return readers.key_set(tables.fundamentals(spark, sf))


@query(
    "table_roundtrip",
    "K-13 K-1",
    sql("tickers", "SELECT ticker, market, status, status_message, last_updated FROM tickers"),
)
def table_roundtrip(spark, sf):
    """Create, truncate, append and read a catalogued table."""
    root = run_folder(spark, "tables")
    schemas.create_tables(spark, root, ["tickers"])
    schemas.truncate_table(spark, root, "tickers")
    tables.tickers(spark, sf).write.mode("append").parquet(f"{root}/tickers")
    return schemas.read_table(spark, root, "tickers")


@query(
    "csv_dump",
    "K-20 K-17",
    sql("tickers", "SELECT ticker, market FROM tickers"),
)
def csv_dump(spark, sf):
    folder = run_folder(spark, "dump")
    write_csv(tables.tickers(spark, sf).select("ticker", "market"), folder)
    return spark.read.schema("ticker string, market string").option("header", True).csv(folder)
