"""Streams give what their batch forms give, whatever the arrival order."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lowtide.criteria import DEFAULT, apply_preset
from lowtide.operators.bars import daily_bars
from lowtide.session import run_folder
from lowtide.sources import json_docs
from lowtide.streaming import lateness, state
from lowtide.streaming import quotes as streaming

SCHEMA = "ticker string, market_data string, last_price double, volume bigint, last_updated timestamp_ntz, seq bigint"
START = dt.datetime(2026, 1, 5)


def quote(seq, minutes, ticker=None, price=None):
    ticker = ticker or ("HOT.NS" if seq % 3 == 0 else f"T{seq % 7}.NS")
    price = float(seq % 50 + 1) if price is None else price
    return (ticker, "{}", price, seq * 10, START + dt.timedelta(minutes=minutes), seq)


def land(spark, folder, batches):
    """One file per batch; the stream takes one file at a time."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    import pyspark.sql.types as T

    schema = T.StructType.fromDDL(SCHEMA)
    return streaming.parquet_stream(spark, folder, schema, files_per_batch=1)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture
def shuffled(spark):
    """Quotes in random order, every tenth one twice."""
    data = [quote(i, i * 37) for i in range(120)]
    data += data[::10]
    random.Random(3).shuffle(data)
    folder = run_folder(spark, "arrivals")
    land(spark, folder, [data[i::4] for i in range(4)])
    return folder


def test_latest_quote_by_batches_and_by_state(spark, shuffled):
    everything = spark.read.schema(SCHEMA).parquet(shuffled)
    want = rows(json_docs.latest_quotes(everything, ["seq"]), "ticker", "last_price", "last_updated")
    out = run_folder(spark, "out")
    streaming.latest_quotes_batches(stream(spark, shuffled), f"{out}/a", f"{out}/ca", tie_break=["seq"]).awaitTermination()
    assert rows(streaming.read_state(spark, f"{out}/a", ["ticker"], "last_updated", ["seq"]), "ticker", "last_price", "last_updated") == want
    newest = streaming.latest_quotes_state(stream(spark, shuffled), ["last_updated", "seq"])
    streaming.to_changes(newest, f"{out}/b", f"{out}/cb", ["ticker"], "last_updated").awaitTermination()
    assert rows(streaming.read_state(spark, f"{out}/b", ["ticker"], "last_updated"), "ticker", "last_price", "last_updated") == want


STATE = (["ticker"], "last_updated")


def test_restart_continues_and_a_new_checkpoint_adds(spark):
    folder, out = run_folder(spark, "arrivals"), run_folder(spark, "out")
    run = lambda c: streaming.latest_quotes_batches(stream(spark, folder), f"{out}/t", f"{out}/{c}").awaitTermination()
    for step in range(3):
        land(spark, folder, [[quote(step, step * 10, "A"), quote(90, 5 - step, "B", 7.0 + step)]])
        run("c")
    assert rows(streaming.read_state(spark, f"{out}/t", *STATE), "ticker", "last_price") == [("A", 3.0), ("B", 7.0)]
    # a fresh checkpoint reads everything again as new batches, the newest rows of all runs count
    land(spark, folder, [[quote(3, 30, "A"), quote(5, 0, "C", 2.0)]])
    run("fresh")
    state = streaming.read_state(spark, f"{out}/t", *STATE)
    assert rows(state, "ticker", "last_price") == [("A", 4.0), ("B", 7.0), ("C", 2.0)]
    assert streaming._committed(spark, f"{out}/t").select("run").distinct().count() == 2


SMALL = "ticker string, p double, last_updated timestamp_ntz"


def test_a_repeated_batch_writes_the_same_folder(spark):
    out = run_folder(spark, "out")
    sink = streaming.change_sink(out, *STATE)
    first = spark.createDataFrame([("A", 1.0, START), ("B", 1.0, START)], SMALL)
    second = spark.createDataFrame([("A", 2.0, START)], SMALL)
    sink(first, 0, "r")
    sink(second, 1, "r")
    sink(second, 1, "r")
    assert rows(streaming.read_state(spark, out, *STATE), "ticker", "p") == [("A", 2.0), ("B", 1.0)]
    changes = spark.read.parquet(f"{out}/changes")
    assert rows(changes.groupBy("batch").count(), "batch", "count") == [(0, 2), (1, 1)]  # as large as the batches


def test_a_reader_sees_committed_batches_only(spark):
    out = run_folder(spark, "out")
    sink = streaming.change_sink(out, *STATE)
    sink(spark.createDataFrame([("A", 1.0, START)], SMALL), 0, "r")
    # a batch that is written but not committed, as while its writer is at work or after it was lost
    half = spark.createDataFrame([("A", 9.0, START + dt.timedelta(days=1))], SMALL).withColumn("_seq", F.lit(2**62))
    half.write.parquet(f"{out}/changes/run=r/batch=1")
    assert rows(streaming.read_state(spark, out, *STATE), "ticker", "p") == [("A", 1.0)]
    sink(spark.createDataFrame([("A", 3.0, START)], SMALL), 1, "r")
    assert rows(streaming.read_state(spark, out, *STATE), "ticker", "p") == [("A", 3.0)]


def test_compaction_keeps_the_state(spark):
    out = run_folder(spark, "out")
    sink = streaming.change_sink(out, *STATE)
    for i in range(4):
        sink(spark.createDataFrame([(t, float(i), START + dt.timedelta(hours=i)) for t in "AB"[: 1 + i % 2]], SMALL), i, "r")
    before = rows(streaming.read_state(spark, out, *STATE), "ticker", "p")
    streaming.compact(spark, out, *STATE)
    assert streaming._committed(spark, out).count() == 1
    assert rows(streaming.read_state(spark, out, *STATE), "ticker", "p") == before
    sink(spark.createDataFrame([("C", 8.0, START)], SMALL), 4, "r")
    assert rows(streaming.read_state(spark, out, *STATE), "ticker", "p") == [*before, ("C", 8.0)]
    streaming.compact(spark, out, *STATE)
    assert rows(streaming.read_state(spark, out, *STATE), "ticker", "p") == [*before, ("C", 8.0)]


@pytest.mark.parametrize("salts", [1, 5])
def test_duplicates_are_dropped(spark, shuffled, salts):
    out = run_folder(spark, "out")
    unique = streaming.without_duplicates(stream(spark, shuffled), ["seq"], lateness="30 days", salts=salts)
    streaming.to_parquet(unique, f"{out}/t", f"{out}/c").awaitTermination()
    got = spark.read.parquet(f"{out}/t")
    assert rows(got, "seq") == [(i,) for i in sorted(range(120), key=lambda i: repr((i,)))]
    assert rows(got, "seq", "last_updated") == rows(
        spark.read.schema(SCHEMA).parquet(shuffled).distinct(), "seq", "last_updated"
    )


def test_daily_bars_equal_the_batch_form(spark, shuffled):
    out = run_folder(spark, "out")
    bars = streaming.daily_bars(stream(spark, shuffled), ["last_updated", "seq"], lateness="30 days")
    streaming.to_changes(bars, f"{out}/t", f"{out}/c", ["ticker", "price_date"], "price_date").awaitTermination()
    batch = daily_bars(
        spark.read.schema(SCHEMA).parquet(shuffled).withColumn("price_date", F.col("last_updated").cast("date")),
        ["ticker"], "last_price", F.col("volume"), ["last_updated", "seq"],
    )
    columns = ["ticker", "price_date", "open", "high", "low", "close", "volume"]
    assert rows(streaming.read_state(spark, f"{out}/t", ["ticker", "price_date"], "price_date"), *columns) == rows(batch, *columns)


def test_late_quotes_follow_the_declared_lateness(spark):
    """High-water mark and watermark differ: a quote within the lateness still counts."""
    folder, out = run_folder(spark, "arrivals"), run_folder(spark, "out")
    land(spark, folder, [[quote(1, 60 * 48, "A")], [quote(2, 60 * 47, "A")], [quote(3, 0, "A")], [quote(4, 60 * 96, "A")]])
    bars = streaming.daily_bars(stream(spark, folder), ["last_updated", "seq"], lateness="2 hours")
    with lateness.ProgressTable(spark, f"{out}/progress"):
        query = streaming.to_parquet(bars, f"{out}/t", f"{out}/c")
        query.awaitTermination()
    got = rows(spark.read.parquet(f"{out}/t"), "price_date", "volume")
    assert got == [(dt.date(2026, 1, 6), 20), (dt.date(2026, 1, 7), 10)]
    dropped = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    assert dropped >= 1  # the quote of the first day came two days late
    late = lateness.late_counts(spark, f"{out}/progress", query)
    assert sum(r["late_rows"] for r in late.collect()) == dropped
    # the batch rule keeps only what is newer than the stored maximum
    stored = spark.createDataFrame([quote(1, 60 * 48, "A")], SCHEMA)
    arrivals = spark.createDataFrame([quote(2, 60 * 47, "A"), quote(3, 60 * 48, "A"), quote(4, 60 * 96, "A")], SCHEMA)
    assert rows(json_docs.newer_than(arrivals, json_docs.high_water_mark(stored)), "seq") == [(4,)]
    assert json_docs.newer_than(arrivals, json_docs.high_water_mark(stored.limit(0))).count() == 3


def test_silent_periods(spark):
    folder, out = run_folder(spark, "arrivals"), run_folder(spark, "out")
    land(spark, folder, [[quote(1, 0, "A"), quote(2, 60, "A")], [quote(3, 60 * 40, "A"), quote(4, 60 * 40, "B")], [quote(5, 60 * 90, "C")]])
    periods = streaming.silent_periods(stream(spark, folder))
    streaming.to_parquet(periods, f"{out}/t", f"{out}/c").awaitTermination()
    got = rows(spark.read.parquet(f"{out}/t"), "ticker", "quotes", "stale_since")
    at = lambda minutes: START + dt.timedelta(minutes=minutes)
    assert got == [("A", 1, at(60 * 64)), ("A", 2, at(60 * 25)), ("B", 1, at(60 * 64))]


def test_stream_screen(spark, shuffled):
    known = spark.createDataFrame(
        [("HOT.NS", 10.0, 60.0, 5e9), ("T1.NS", None, None, 5e9)],
        "ticker string, xml_52w_low double, xml_52w_high double, mkt_cap_usd double",
    )
    from dataclasses import replace

    criteria = replace(apply_preset(DEFAULT, "wide"), price_52w_low_pct=2.0, min_volume=300, rsi_enabled=False)
    out = run_folder(spark, "out")
    caught = streaming.screened_quotes(stream(spark, shuffled), known, criteria)
    streaming.to_parquet(caught.select("symbol", "price", "seq"), f"{out}/t", f"{out}/c", every=None).awaitTermination()
    batch = streaming.screened_quotes(spark.read.schema(SCHEMA).parquet(shuffled), known, criteria)
    assert rows(spark.read.parquet(f"{out}/t"), "symbol", "price", "seq") == rows(batch, "symbol", "price", "seq")
    assert batch.count() > 0


def test_cadence(spark, shuffled):
    out = run_folder(spark, "out")
    query = streaming.latest_quotes_batches(stream(spark, shuffled), f"{out}/t", f"{out}/c", every="1 second", tie_break=["seq"])
    query.processAllAvailable()
    assert query.isActive
    query.stop()
    query.awaitTermination()
    assert streaming.read_state(spark, f"{out}/t", ["ticker"], "last_updated").count() > 0


# --- per-key state and timers ------------------------------------------------------------------


def newest(spark, folder, out, name="c", **options):
    found = state.newest_quotes(stream(spark, folder), ["seq"], **options)
    with state.rocksdb_state(spark):
        query = streaming.to_changes(found, f"{out}/t", f"{out}/{name}", ["ticker"], "last_updated", tie_break=["expired"])
    query.awaitTermination()
    return streaming.read_state(spark, f"{out}/t", ["ticker"], "last_updated", ["expired"])


def test_value_state_keeps_the_newest_whatever_the_order(spark, shuffled):
    everything = spark.read.schema(SCHEMA).parquet(shuffled)
    want = rows(json_docs.latest_quotes(everything, ["seq"]), "ticker", "last_price", "last_updated")
    got = newest(spark, shuffled, run_folder(spark, "out"), lateness="30 days")
    assert rows(got, "ticker", "last_price", "last_updated") == want
    assert got.columns[:2] == ["ticker", "last_price"] and got.filter("expired").count() == 0


def test_value_state_goes_on_after_a_restart_and_begins_from_a_table(spark):
    folder, out = run_folder(spark, "arrivals"), run_folder(spark, "out")
    known = json_docs.parse_quotes(spark.createDataFrame([quote(50, 60, "K", 5.0), quote(51, 60, "A", 1.0)], SCHEMA))
    land(spark, folder, [[quote(1, 30, "K", 9.0), quote(2, 120, "A", 2.0)], [quote(3, 90, "A", 3.0), quote(4, 0, "B", 4.0)]])
    got = newest(spark, folder, out, lateness="30 days", known=known)
    # K's only arrival is older than what the table had, so nothing of K is emitted
    assert rows(got, "ticker", "last_price") == [("A", 2.0), ("B", 4.0)]
    land(spark, folder, [[quote(5, 100, "A", 5.0), quote(6, 1, "B", 6.0)]])
    got = newest(spark, folder, out, lateness="30 days", known=known)
    assert rows(got, "ticker", "last_price") == [("A", 2.0), ("B", 6.0)]


def test_value_state_expires(spark):
    folder, out = run_folder(spark, "arrivals"), run_folder(spark, "out")
    land(spark, folder, [[quote(1, 0, "A", 1.0), quote(2, 10, "B", 2.0)], [quote(3, 60 * 10, "B", 3.0)], [quote(4, 60 * 12, "C", 4.0)]])
    got = newest(spark, folder, out, ttl_hours=5)
    assert rows(got, "ticker", "last_price", "expired") == [("A", 1.0, True), ("B", 3.0, False), ("C", 4.0, False)]
    land(spark, folder, [[quote(5, 60 * 13, "A", 5.0)]])  # a forgotten key comes back
    got = newest(spark, folder, out, ttl_hours=5)
    assert rows(got, "ticker", "last_price", "expired") == [("A", 5.0, False), ("B", 3.0, False), ("C", 4.0, False)]


def test_silences_of_known_unknown_and_stopped_tickers(spark):
    import pyspark.sql.types as T

    folder, out = run_folder(spark, "arrivals"), run_folder(spark, "out")
    at = lambda hours: START + dt.timedelta(hours=hours)
    land(spark, folder, [[quote(1, 0, "A"), quote(2, 60 * 30, "A"), quote(3, 60, "B")], [quote(4, 60 * 31, "B"), quote(5, 60 * 33, "A")]])
    clock = T.StructType.fromDDL("at timestamp_ntz")
    spark.createDataFrame([], clock).write.parquet(f"{out}/clock")
    universe = spark.createDataFrame([("A", at(0)), ("NEVER", at(2)), ("NEVER", at(5))], "ticker string, since timestamp_ntz")

    def run():
        hands = streaming.parquet_stream(spark, f"{out}/clock", clock)
        silent = state.silent_tickers(stream(spark, folder), hands, 24, universe=universe)
        with state.rocksdb_state(spark):
            streaming.to_parquet(silent, f"{out}/t", f"{out}/c").awaitTermination()
        return rows(spark.read.parquet(f"{out}/t"), "ticker", "last_quote", "stale_since")

    first = [("A", at(0), at(24)), ("B", at(1), at(25)), ("NEVER", None, at(26))]
    assert run() == first
    assert run() == first  # nothing new, nothing told twice
    # the feed has stopped; only the clock goes on
    spark.createDataFrame([(at(80),)], clock).write.mode("append").parquet(f"{out}/clock")
    assert run() == sorted([*first, ("A", at(33), at(57)), ("B", at(31), at(55))], key=repr)


# --- late rows ---------------------------------------------------------------------------------


def test_late_rows_of_more_than_a_hundred_triggers(spark):
    folder, out = run_folder(spark, "arrivals"), run_folder(spark, "out")
    data = [[quote(i, 0 if i % 10 == 9 else i * 30, "A")] for i in range(104)]
    land(spark, folder, data)
    sink = lateness.split_late(f"{out}/l", "last_updated", "1 hour", lambda batch, number: None)
    with lateness.ProgressTable(spark, f"{out}/progress"):
        writer = stream(spark, folder).writeStream.foreachBatch(sink).option("checkpointLocation", f"{out}/c")
        query = streaming.with_cadence(writer).start()
        query.awaitTermination()
    figures = lateness.batch_figures(spark, f"{out}/l")
    assert figures.count() == 104 and figures.agg(F.sum("late_rows")).first()[0] == 10
    assert rows(lateness.late_rows(spark, f"{out}/l"), "seq") == sorted([(i,) for i in range(9, 104, 10)], key=repr)
    heard = lateness.late_counts(spark, f"{out}/progress", query).filter("input_rows > 0")
    assert heard.count() == 104 > len(query.recentProgress)


def test_a_batch_that_runs_again_decides_as_before(spark):
    out = run_folder(spark, "out")
    taken = []
    sink = lateness.split_late(out, "last_updated", "1 hour", lambda batch, number: taken.append((number, batch.count())))
    for number, minutes in ((0, 600), (1, 0), (1, 0), (2, 570)):
        sink(spark.createDataFrame([quote(number, minutes, "A")], SCHEMA), number)
    assert taken == [(0, 1), (1, 0), (1, 0), (2, 1)]
    assert rows(lateness.late_rows(spark, out), "seq") == [(1,)]


# --- deletes and compaction ----------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_deletes_changes_and_compactions_in_any_order(spark, seed):
    r = random.Random(seed)
    out, want = run_folder(spark, "out"), {}
    sink = streaming.change_sink(out, *STATE)
    steps = [("put", k, t) for k in "AB" for t in (1, 3, 5)] + [("drop", "A", 4), ("drop", "B", 2), ("compact", "", 0), ("compact", "", 0)]
    r.shuffle(steps)
    steps.insert(0, ("put", "C", 1))
    for n, (what, key, hours) in enumerate(steps):
        at = START + dt.timedelta(hours=hours)
        if what == "put":
            sink(spark.createDataFrame([(key, float(hours), at)], SMALL), n, "r")
            want[key] = max(want.get(key, (0, None)), (hours, float(hours)))
        elif what == "drop":
            streaming.delete_keys(spark.createDataFrame([(key,)], "ticker string"), out, *STATE, at)
            want[key] = max(want.get(key, (0, None)), (hours, 0.0))
        else:
            streaming.compact(spark, out, *STATE)
    left = sorted((k, p) for k, (_, p) in want.items() if p)
    assert rows(streaming.read_state(spark, out, *STATE), "ticker", "p") == left


def test_a_batch_committed_beside_a_compaction_still_counts(spark, monkeypatch):
    out = run_folder(spark, "out")
    sink = streaming.change_sink(out, *STATE)
    sink(spark.createDataFrame([("A", 1.0, START)], SMALL), 0, "r")
    plain = streaming._newest

    def meanwhile(*args):  # another run commits after the list of batches was taken, by a clock that is behind
        monkeypatch.setattr(streaming, "_newest", plain)
        monkeypatch.setattr(streaming._clock, "time_ns", lambda: 1)
        sink(spark.createDataFrame([("B", 2.0, START)], SMALL), 0, "other")
        monkeypatch.undo()
        return plain(*args)

    monkeypatch.setattr(streaming, "_newest", meanwhile)
    streaming.compact(spark, out, *STATE)
    assert rows(streaming.read_state(spark, out, *STATE), "ticker", "p") == [("A", 1.0), ("B", 2.0)]


def test_tombstones_retire_and_conditions_delete(spark):
    out = run_folder(spark, "out")
    sink = streaming.change_sink(out, *STATE)
    sink(spark.createDataFrame([("A.NS", 1.0, START), ("B", 1.0, START)], SMALL), 0, "r")
    later = START + dt.timedelta(days=1)
    streaming.delete_where(spark, out, *STATE, F.col("ticker").endswith(".NS"), later)
    assert rows(streaming.read_state(spark, out, *STATE), "ticker") == [("B",)]
    streaming.compact(spark, out, *STATE, retire_before=later)  # not before: it stays
    changes = lambda: streaming._changes(spark, out, streaming._committed(spark, out)).filter("_deleted").count()
    assert changes() == 1
    streaming.compact(spark, out, *STATE, retire_before=later + dt.timedelta(days=1))
    assert changes() == 0 and rows(streaming.read_state(spark, out, *STATE), "ticker") == [("B",)]
