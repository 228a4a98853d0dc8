"""Streaming jobs, run to the end of the available input; twins are their batch forms."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lowtide.checks.base import query, sql
from lowtide.checks.screens import STORED
from lowtide.session import run_folder
from lowtide.sources import benchmark_tables as tables
from lowtide.streaming import lateness, state
from lowtide.streaming import quotes as streaming


BATCHES = 4


def events_stream(spark, sf, in_order=True):
    """The events in four ranges of their ids, or mixed, that become a micro-batch each.

    A range is written by as many tasks as the session has cores, and a batch takes as many files."""
    events = tables.load(spark, sf, "events")
    last, rows = events.agg(F.max("event_id"), F.count("*")).first()
    number = F.floor(F.col("event_id") * BATCHES / ((last or 0) + 1)) if in_order else F.col("event_id") % BATCHES
    files = max(1, min(spark.sparkContext.defaultParallelism, rows // (200 * BATCHES)))
    folder = run_folder(spark, "arrivals")
    for i in range(BATCHES):  # one after the other, as the stream takes files by their age
        events.filter(number == i).repartition(files).write.mode("append").parquet(folder)
    return streaming.parquet_stream(spark, folder, events.schema, files_per_batch=files)


def quotes_stream(spark, sf):
    return tables.raw_quotes_of(events_stream(spark, sf))


def _finish(query):
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


COLUMNS = "ticker, last_price, close_price, volume, last_updated"


@query("stream_latest_quote", "T-1 T-8", sql("latest", f"SELECT {COLUMNS} FROM latest"))
def stream_latest_quote(spark, sf):
    folder = run_folder(spark, "latest")
    _finish(
        streaming.latest_quotes_batches(
            quotes_stream(spark, sf), f"{folder}/table", f"{folder}/checkpoint", tie_break=["event_id"]
        )
    )
    state = streaming.read_state(spark, f"{folder}/table", ["ticker"], "last_updated", ["event_id"])
    return state.select(COLUMNS.split(", "))


@query("stream_latest_state", "T-2", sql("latest", f"SELECT {COLUMNS} FROM latest"))
def stream_latest_state(spark, sf):
    folder = run_folder(spark, "state")
    newest = streaming.latest_quotes_state(quotes_stream(spark, sf), ["last_updated", "event_id"])
    _finish(
        streaming.to_changes(
            newest, f"{folder}/table", f"{folder}/checkpoint", ["ticker"], "last_updated"
        )
    )
    return streaming.read_state(spark, f"{folder}/table", ["ticker"], "last_updated").select(COLUMNS.split(", "))


@query(
    "stream_without_duplicates",
    "T-3 T-4",
    sql("quotes", "SELECT ticker, last_price, volume, last_updated FROM quotes"),
)
def stream_without_duplicates(spark, sf):
    """Every quote arrives three times; one of each is kept."""
    from lowtide.sources.json_docs import parse_quotes

    folder = run_folder(spark, "unique")
    copies = parse_quotes(quotes_stream(spark, sf)).withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.lit(3)))
    )
    unique = streaming.without_duplicates(copies, ["ticker", "last_updated"])
    _finish(streaming.to_parquet(unique, f"{folder}/table", f"{folder}/checkpoint"))
    return spark.read.parquet(f"{folder}/table").select(
        "ticker", "last_price", "volume", "last_updated"
    )


@query(
    "stream_silent_periods",
    "T-5",
    sql(
        "quotes",
        """SELECT ticker, count(*) AS quotes, max(last_updated) AS last_quote,
                  max(last_updated) + INTERVAL 6 HOUR AS stale_since
           FROM (SELECT *, sum(starts) OVER (PARTITION BY ticker ORDER BY last_updated, event_id) AS period
                 FROM (SELECT *, CASE WHEN last_updated - lag(last_updated) OVER
                         (PARTITION BY ticker ORDER BY last_updated, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS starts
                       FROM quotes))
           GROUP BY ticker, period
           HAVING max(last_updated) + INTERVAL 6 HOUR <=
             (SELECT date_trunc('millisecond', max(last_updated)) - INTERVAL 1 HOUR FROM quotes)""",
    ),
)
def stream_silent_periods(spark, sf):
    from lowtide.sources.json_docs import parse_quotes

    folder = run_folder(spark, "silent")
    periods = streaming.silent_periods(parse_quotes(quotes_stream(spark, sf)), gap="6 hours")
    _finish(streaming.to_parquet(periods, f"{folder}/table", f"{folder}/checkpoint"))
    return spark.read.parquet(f"{folder}/table")


@query(
    "stream_daily_bars",
    "T-6",
    sql(
        "quotes",
        """SELECT ticker, CAST(last_updated AS DATE) AS price_date,
                  first(last_price ORDER BY last_updated, event_id) AS open, max(last_price) AS high,
                  min(last_price) AS low, last(last_price ORDER BY last_updated, event_id) AS close,
                  CAST(sum(volume) AS BIGINT) AS volume
           FROM quotes WHERE last_price IS NOT NULL GROUP BY ALL""",
    ),
)
def stream_daily_bars(spark, sf):
    from lowtide.sources.json_docs import parse_quotes

    folder = run_folder(spark, "bars")
    bars = streaming.daily_bars(parse_quotes(quotes_stream(spark, sf)), ["last_updated", "event_id"])
    _finish(
        streaming.to_changes(
            bars, f"{folder}/table", f"{folder}/checkpoint", ["ticker", "price_date"], "price_date"
        )
    )
    return streaming.read_state(spark, f"{folder}/table", ["ticker", "price_date"], "price_date")


@query(
    "stream_late_rows",
    "T-3",
    sql(
        "quotes",
        f"""SELECT CAST(batch AS BIGINT) AS batch,
                   CAST(count(*) FILTER (last_updated <= (SELECT date_trunc('millisecond', max(newest)) - INTERVAL 1 HOUR
                                                          FROM seen WHERE seen.batch < arrived.batch - 1)) AS BIGINT) AS late_rows
            FROM arrived GROUP BY batch""",
        f"""arrived AS (SELECT event_id % {BATCHES} AS batch, last_updated FROM quotes),
            seen AS (SELECT batch, max(last_updated) AS newest FROM arrived GROUP BY batch)""",
    ),
)
def stream_late_rows(spark, sf):
    """Rows of each batch that came too late for the duplicate check.  A batch is judged by the
    watermark that the batch before the last one left."""
    from lowtide.sources.json_docs import parse_quotes

    folder = run_folder(spark, "late")
    unique = streaming.without_duplicates(parse_quotes(tables.raw_quotes_of(events_stream(spark, sf, in_order=False))), ["event_id"], salts=1)
    with lateness.ProgressTable(spark, f"{folder}/progress"):
        running = streaming.to_parquet(unique, f"{folder}/table", f"{folder}/checkpoint")
        _finish(running)
    found = lateness.late_counts(spark, f"{folder}/progress", running)
    return found.filter("input_rows > 0").select("batch", "late_rows")


@query(
    "stream_late_side_output",
    "T-3",
    sql(
        "quotes",
        f"""SELECT CAST(batch AS BIGINT) AS batch, event_id, ticker, last_updated,
                   last_updated <= (SELECT max(newest) - INTERVAL 1 HOUR FROM seen WHERE seen.batch < arrived.batch) IS TRUE AS late
            FROM arrived""",
        f"""arrived AS (SELECT event_id % {BATCHES} AS batch, event_id, ticker, last_updated FROM quotes),
            seen AS (SELECT batch, max(last_updated) AS newest FROM arrived GROUP BY batch)""",
    ),
)
def stream_late_side_output(spark, sf):
    """Every row of the stream goes to one of two tables: the timely ones, and the late ones."""
    from lowtide.sources.json_docs import parse_quotes

    folder = run_folder(spark, "late")
    arrived = parse_quotes(tables.raw_quotes_of(events_stream(spark, sf, in_order=False)))

    def timely(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/timely/batch={number}")

    sink = lateness.split_late(f"{folder}/table", "last_updated", "1 hour", timely)
    writer = arrived.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint")
    _finish(streaming.with_cadence(writer).start())
    columns = ["event_id", "ticker", "last_updated"]
    kept = spark.read.parquet(f"{folder}/timely").select(F.col("batch").cast("bigint"), *columns, F.lit(False).alias("late"))
    late = lateness.late_rows(spark, f"{folder}/table").select(F.col("batch").cast("bigint"), *columns, F.lit(True).alias("late"))
    return kept.unionByName(late)


TTL_HOURS = 36


@query(
    "stream_state_ttl",
    "T-2",
    sql(
        "latest quotes",
        f"""SELECT {COLUMNS}, last_updated + INTERVAL {TTL_HOURS} HOUR <=
              (SELECT date_trunc('millisecond', max(last_updated)) - INTERVAL 1 HOUR FROM quotes) AS expired FROM latest""",
    ),
)
def stream_state_ttl(spark, sf):
    """Newest quote per ticker as a value state that is forgotten after 36 hours without a newer one."""
    folder = run_folder(spark, "ttl")
    newest = state.newest_quotes(quotes_stream(spark, sf), ["event_id"], ttl_hours=TTL_HOURS)
    with state.rocksdb_state(spark):
        running = streaming.to_changes(
            newest, f"{folder}/table", f"{folder}/checkpoint", ["ticker"], "last_updated", tie_break=["expired"]
        )
    _finish(running)
    found = streaming.read_state(spark, f"{folder}/table", ["ticker"], "last_updated", ["expired"])
    return found.select(*COLUMNS.split(", "), "expired")


MONITOR_START, GAP_HOURS, SILENT_UNTIL = "2024-01-01 00:00:00", 60, "2024-02-05 12:00:00"


@query(
    "stream_stale_now",
    "T-5",
    sql(
        "quotes listings",
        f"""SELECT ticker, CASE WHEN seed THEN NULL ELSE last_updated END AS last_quote,
                   last_updated + INTERVAL {GAP_HOURS} HOUR AS stale_since
            FROM (SELECT *, lead(last_updated) OVER (PARTITION BY ticker ORDER BY last_updated, seed DESC) AS next
                  FROM (SELECT DISTINCT ticker, last_updated, FALSE AS seed FROM quotes
                        UNION ALL SELECT DISTINCT ticker, TIMESTAMP '{MONITOR_START}', TRUE FROM listings WHERE kind = 'customer'))
            WHERE coalesce(next, TIMESTAMP '{SILENT_UNTIL}' - INTERVAL 1 HOUR) >= last_updated + INTERVAL {GAP_HOURS} HOUR""",
    ),
)
def stream_stale_now(spark, sf):
    """Tickers that fell silent, those that never came included, also when the whole feed has stopped.

    The feed ends first; then only the clock goes on, in a second run from the same checkpoint."""
    from lowtide.sources.json_docs import parse_quotes

    folder = run_folder(spark, "stale")
    seconds = "at timestamp_ntz"
    spark.createDataFrame([], seconds).write.parquet(f"{folder}/clock")
    expected = tables.listings(spark, sf).filter("kind = 'customer'").select("ticker", F.lit(MONITOR_START).cast("timestamp_ntz").alias("since"))
    arrivals = parse_quotes(quotes_stream(spark, sf))
    clock = streaming.parquet_stream(spark, f"{folder}/clock", StructType.fromDDL(seconds))
    silent = state.silent_tickers(arrivals, clock, GAP_HOURS, universe=expected)
    for _ in range(2):
        with state.rocksdb_state(spark):
            running = streaming.to_parquet(silent, f"{folder}/table", f"{folder}/checkpoint")
        _finish(running)
        now = spark.range(1).select(F.lit(SILENT_UNTIL).cast("timestamp_ntz").alias("at"))
        now.coalesce(1).write.mode("append").parquet(f"{folder}/clock")
    return spark.read.parquet(f"{folder}/table")


@query("stream_cadence", "T-8", sql("latest", f"SELECT {COLUMNS}, CAST({BATCHES} AS BIGINT) AS batches FROM latest"))
def stream_cadence(spark, sf):
    """The same job on a clock: a batch at most every 100 milliseconds until all that came is done."""
    folder = run_folder(spark, "cadence")
    running = streaming.latest_quotes_batches(
        quotes_stream(spark, sf), f"{folder}/table", f"{folder}/checkpoint", every="100 milliseconds", tie_break=["event_id"]
    )
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    found = streaming.read_state(spark, f"{folder}/table", ["ticker"], "last_updated", ["event_id"])
    batches = spark.read.parquet(f"{folder}/table/commits").select("batch").distinct().count()
    return found.select(*COLUMNS.split(", "), F.lit(batches).cast("bigint").alias("batches"))


@query(
    "change_deletes",
    "K-10 K-11 K-12 T-1",
    sql(
        "quotes",
        f"""SELECT {COLUMNS} FROM quotes
            WHERE NOT (ticker LIKE '%.NS' AND last_updated <= TIMESTAMP '2024-01-20 00:00:00')
            QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY last_updated DESC, event_id DESC) = 1""",
    ),
)
def change_deletes(spark, sf):
    """A whole exchange is deleted as of a day while its changes still come, older and newer ones, with
    compactions between: what is left are the keys with a change after that day."""
    from lowtide.sources.json_docs import parse_quotes

    path, keys, time = run_folder(spark, "deletes"), ["ticker"], "last_updated"
    rows = parse_quotes(tables.raw_quotes(spark, sf))
    sink = streaming.change_sink(path, keys, time, ["event_id"])
    part = lambda i: rows.filter(F.col("event_id") % BATCHES == i)
    sink(part(0), 0, "first")
    named = rows.filter(F.col("ticker").endswith(".NS"))
    streaming.delete_keys(named, path, keys, time, "2024-01-20 00:00:00")
    sink(part(1), 1, "first")
    streaming.compact(spark, path, keys, time, ["event_id"])
    sink(part(2), 0, "second")
    streaming.compact(spark, path, keys, time, ["event_id"], retire_before="2024-01-19 00:00:00")
    sink(part(3), 1, "second")
    return streaming.read_state(spark, path, keys, time, ["event_id"]).select(COLUMNS.split(", "))


@query(
    "stream_screen",
    "T-7",
    sql(
        "quotes fundamentals",
        """SELECT q.event_id, q.ticker AS symbol, last_price AS price, volume
           FROM quotes q LEFT JOIN fundamentals f ON f.ticker = q.ticker
           WHERE last_price BETWEEN 1e0 AND 1e3 AND volume >= 20000
             AND (xml_52w_low IS NULL OR NOT xml_52w_low > 0 OR (last_price / xml_52w_low <= 3e0
                  AND (xml_52w_high IS NULL OR NOT xml_52w_high > 0 OR last_price / xml_52w_high <= 9e-1)))""",
    ),
)
def stream_screen(spark, sf):
    folder = run_folder(spark, "screen")
    caught = streaming.screened_quotes(
        quotes_stream(spark, sf), tables.fundamentals(spark, sf), STORED
    ).select("event_id", "symbol", "price", "volume")
    _finish(streaming.to_parquet(caught, f"{folder}/table", f"{folder}/checkpoint"))
    return spark.read.parquet(f"{folder}/table")


@query(
    "stream_screen_features",
    "T-7",
    sql(
        "quotes fundamentals",
        """SELECT q.event_id, q.ticker AS symbol, last_price AS price, q.volume, round(q.volume / usual, 6) AS rvol
           FROM quotes q JOIN usual USING (ticker) LEFT JOIN fundamentals f ON f.ticker = q.ticker
           WHERE last_price BETWEEN 1e0 AND 1e3 AND q.volume / usual BETWEEN 5e-1 AND 2e1
             AND (xml_52w_low IS NULL OR NOT xml_52w_low > 0 OR (last_price / xml_52w_low <= 3e0
                  AND (xml_52w_high IS NULL OR NOT xml_52w_high > 0 OR last_price / xml_52w_high <= 9e-1)))""",
        """days AS (
             SELECT ticker, CAST(last_updated AS DATE) AS day, sum(volume) AS v, last(last_price ORDER BY last_updated, event_id) AS c
             FROM quotes WHERE last_price IS NOT NULL GROUP BY ALL),
           usual AS (
             SELECT ticker, CASE WHEN max(n) >= 20 THEN sum(v) FILTER (back <= 20) / 2e1 ELSE max(v) FILTER (back = 1) * 1e0 END AS usual
             FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY day) AS n,
                          row_number() OVER (PARTITION BY ticker ORDER BY day DESC) AS back FROM days)
             GROUP BY ticker)""",
    ),
)
def stream_screen_features(spark, sf):
    """The screened stream with the stored average volume of each ticker: RVOL alone decides on liquidity."""
    from lowtide.operators import indicators
    from lowtide.operators.bars import daily_bars
    from lowtide.sources.json_docs import parse_quotes

    folder = run_folder(spark, "screen")
    priced = parse_quotes(tables.raw_quotes(spark, sf)).filter("last_price IS NOT NULL")
    bars = daily_bars(
        priced.withColumn("price_date", F.col("last_updated").cast("date")),
        ["ticker"], "last_price", F.coalesce("volume", F.lit(0)), ["last_updated", "event_id"],
    )
    features = indicators.latest_per_key(indicators.feature_panel(bars), ["ticker"], ["price_date"])
    features.write.parquet(f"{folder}/features")
    caught = streaming.screened_quotes(
        quotes_stream(spark, sf),
        tables.fundamentals(spark, sf),
        replace(STORED, min_volume=10**12, min_rvol=0.5, min_avg_volume_20d=None, min_days_since_low=None, max_days_since_low=None, ma_enabled=False, atr_enabled=False, pattern_enabled=False),
        spark.read.parquet(f"{folder}/features"),
    ).select("event_id", "symbol", "price", "volume", F.round("rvol", 6).alias("rvol"))
    _finish(streaming.to_parquet(caught, f"{folder}/table", f"{folder}/checkpoint"))
    return spark.read.parquet(f"{folder}/table")
