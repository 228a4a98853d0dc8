"""Per-key state with timers: the newest quote of each ticker, and tickers that fall silent.

Both are ``transformWithState`` processors.  A ticker's state is one value, kept by RocksDB outside the
heap; state may begin from a stored table, and event-time timers forget or report keys without a new
arrival.  Rows are combined per key and Arrow batch before the shuffle, so a hot ticker costs the
processor a row a batch of input and not a row a quote.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lowtide.functions.times import utc_instant, utc_wall_clock
from lowtide.sources.json_docs import parse_quotes

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, as ``transformWithState`` asks for."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _instants(quotes: DataFrame, time: str) -> DataFrame:
    if dict(quotes.dtypes)[time] == "timestamp_ntz":
        return quotes.withColumn(time, utc_instant(F.col(time)))
    return quotes


def _last_of_keys(batch: pa.RecordBatch, key: str, order: list[str]) -> pa.RecordBatch:
    """The row of each key that is last by the order columns; nulls come first."""
    at = pc.sort_indices(batch.select(order), sort_keys=[(c, "ascending") for c in order], null_placement="at_start")
    codes = batch.column(key).take(at).dictionary_encode().indices
    number = np.asarray(codes.fill_null(-1) if codes.null_count else codes)
    _, last = np.unique(number[::-1], return_index=True)
    return batch.take(at.take(pa.array(len(number) - 1 - last)))


# --- newest row per key ------------------------------------------------------------------------


class Newest(StatefulProcessor):
    """Keeps and emits the newest row of a key; older arrivals change nothing.

    With ``ttl_ms`` a key is forgotten, and its row emitted once more as expired, when the watermark
    has passed its newest time by so much."""

    def __init__(self, columns: list[str], order: list[str], schema: str, ttl_ms: int | None):
        self.columns, self.order, self.schema, self.ttl_ms = columns, order, schema, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", self.schema)
        self.places = [self.columns.index(c) for c in self.order]

    def _rank(self, row: tuple) -> tuple:
        return tuple((row[i] is not None, row[i]) for i in self.places)

    def _due(self, row: tuple) -> int:
        return -(-row[self.places[0]] // 1000) + self.ttl_ms

    def _keep(self, row: tuple) -> bool:
        if self.newest.exists():
            known = tuple(self.newest.get())
            if self._rank(known) > self._rank(row):
                return False
            if self.ttl_ms is not None:
                self.handle.deleteTimer(self._due(known))
        self.newest.update(row)
        if self.ttl_ms is not None:
            self.handle.registerTimer(self._due(row))
        return True

    def _row(self, key: tuple, row: tuple, expired: bool) -> Row:
        return Row(**dict(zip(["_key", *self.columns, "expired"], [key[0], *row, expired])))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        best = max((tuple(r[c] for c in self.columns) for r in rows), key=self._rank)
        if self._keep(best):
            yield self._row(key, best, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = tuple(self.newest.get())
        self.newest.clear()
        yield self._row(key, known, True)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._keep(tuple(initialState[c] for c in self.columns))

    def close(self) -> None:
        pass


def newest_per_key(
    rows: DataFrame,
    key: str,
    time: str,
    tie_break: list[str],
    *,
    lateness: str = "1 hour",
    ttl_hours: float | None = None,
    known: DataFrame | None = None,
) -> DataFrame:
    """The newest row of every key as a stream of changes: all columns and ``expired``.

    ``known`` is a table of rows with which the state begins.  Rows without a time are left out; rows that are later than
    the lateness allows are dropped by the watermark."""

    def plain(df: DataFrame) -> DataFrame:
        df = _instants(df.filter(F.col(time).isNotNull()), time)
        return df.withColumn(time, F.unix_micros(time)).withColumnRenamed(key, "_key")

    arrived = plain(rows)
    columns = [c for c in arrived.columns if c != "_key"]
    order = [time, *tie_break]
    fields = {f.name: f.dataType.simpleString() for f in arrived.schema}

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _last_of_keys(batch, "_key", order)

    ddl = ", ".join(f"`{c}` {fields[c]}" for c in arrived.columns)
    arrived = arrived.mapInArrow(combine, ddl).withColumn("_at", F.timestamp_micros(time)).withWatermark("_at", lateness)
    state = ", ".join(f"`{c}` {fields[c]}" for c in columns)
    processor = Newest(columns, order, state, None if ttl_hours is None else int(ttl_hours * 3_600_000))
    start = None if known is None else plain(known).select("_key", *columns).groupBy("_key")
    newest = arrived.groupBy("_key").transformWithState(
        processor, f"_key {fields['_key']}, {state}, expired boolean", "Update", "EventTime", initialState=start
    )
    wall_clock = utc_wall_clock(F.timestamp_micros(time))
    return newest.withColumn(time, wall_clock).withColumnRenamed("_key", key).select(*rows.columns, "expired")


def newest_quotes(quotes: DataFrame, tie_break: list[str], **options) -> DataFrame:
    """Raw quotes -> the newest quote per ticker; see ``newest_per_key``."""
    return newest_per_key(parse_quotes(quotes), "ticker", "last_updated", tie_break, **options)


# --- silent keys -------------------------------------------------------------------------------


class Silence(StatefulProcessor):
    """Reports a key once for each time that nothing of it comes for the gap.

    State: the last time, and whether the silence after it has been told.  A silence is told by a timer
    when the watermark passes its beginning, or by the arrival that ends it if that comes first."""

    def __init__(self, gap_us: int):
        self.gap = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last long, told boolean, arrivals long")

    def _due(self, last: int) -> int:
        return -(-(last + self.gap) // 1000)

    def _row(self, key: tuple, last: int, arrivals: int) -> Row:
        return Row(ticker=key[0], last_us=last if arrivals else None, stale_us=last + self.gap)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        spans = sorted((r["first_us"], r["last_us"], r["n"]) for r in rows)
        if key[0] is None:  # the clock
            return
        known = tuple(self.seen.get()) if self.seen.exists() else None
        last, told, arrivals = known or (None, False, 0)
        for first, end, n in spans:
            if last is not None and first - last >= self.gap and not told:
                yield self._row(key, last, arrivals)
            arrivals += n
            if last is None or end > last:
                last, told = end, False
        if known and not known[1]:
            self.handle.deleteTimer(self._due(known[0]))
        self.seen.update((last, told, arrivals))
        if not told:
            self.handle.registerTimer(self._due(last))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last, _, arrivals = self.seen.get()
        self.seen.update((last, True, arrivals))
        yield self._row(key, last, arrivals)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.seen.update((initialState["since_us"], False, 0))
        self.handle.registerTimer(self._due(initialState["since_us"]))

    def close(self) -> None:
        pass


def silent_tickers(
    quotes: DataFrame,
    clock: DataFrame,
    gap_hours: float = 24,
    *,
    universe: DataFrame | None = None,
    time: str = "last_updated",
    lateness: str = "1 hour",
) -> DataFrame:
    """One row per ticker and silence of at least the gap: ``ticker, last_quote, stale_since``.

    ``clock`` is a stream of instants (one column) that goes on when the feed has stopped, as of a rate source: it
    moves the watermark, so silences fall due without any quote.  ``universe`` (ticker, since) seeds the
    tickers that are expected; one of which nothing ever came is reported with a NULL ``last_quote``.  A
    quote that is late, but within the lateness, does not take back a silence that was told."""
    gap = int(gap_hours * 3_600_000_000)
    (tick,) = clock.columns
    arrived = _instants(quotes.filter(F.col("ticker").isNotNull() & F.col(time).isNotNull()), time)
    arrived = arrived.select("ticker", F.unix_micros(time).alias("us"))
    hands = _instants(clock, tick).select(F.lit(None).cast("string").alias("ticker"), F.unix_micros(tick).alias("us"))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Times of a key that follow each other within the gap as one span."""
        for batch in batches:
            codes = batch.column("ticker").dictionary_encode(null_encoding="encode")
            number, us = np.asarray(codes.indices), np.asarray(batch.column("us"))
            order = np.lexsort((us, number))
            number, us = number[order], us[order]
            new = np.ones(len(us), bool)
            new[1:] = (number[1:] != number[:-1]) | (us[1:] - us[:-1] >= gap)
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(us)) - 1
            columns = [pa.array(us[begin]), pa.array(us[end]), pa.array((end - begin + 1).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([codes.dictionary.take(pa.array(number[begin])), *columns], names=["ticker", "first_us", "last_us", "n"])

    spans = arrived.unionByName(hands).mapInArrow(combine, "ticker string, first_us long, last_us long, n long")
    spans = spans.withColumn("_at", F.timestamp_micros("last_us")).withWatermark("_at", lateness)
    start = None
    if universe is not None:
        since = _instants(universe.groupBy("ticker").agg(F.min("since").alias("since")), "since")
        start = since.select("ticker", F.unix_micros("since").alias("since_us")).groupBy("ticker")
    told = spans.groupBy("ticker").transformWithState(
        Silence(gap), "ticker string, last_us long, stale_us long", "Append", "EventTime", initialState=start
    )
    at = lambda c: utc_wall_clock(F.timestamp_micros(c))
    return told.select("ticker", at("last_us").alias("last_quote"), at("stale_us").alias("stale_since"))
