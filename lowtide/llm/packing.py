"""Packing of documents into sequences by bin completion.

Documents become token ids; those longer than a sequence are cut into whole sequences and a rest.
Only the *lengths* of the pieces matter for packing, and there are at most ``capacity`` different
ones.  So the plan is made on the histogram of lengths, whose size does not depend on the corpus:

* best-fit decreasing gives the incumbent;
* if it needs more sequences than the bound ceil(total / capacity), branch and bound tries to need
  fewer: around the largest piece that is left it enumerates the undominated fillings of a
  sequence, fullest first, puts one on as many sequences as the counts allow, later on one alone, and goes
  back where the waste so far exceeds what the aimed number of sequences leaves.  Numbers are aimed at
  from the bound upwards as long as it is proved that a number is too small, and then from above.

The search has a budget (``FILLINGS``, ``NODES``, ``STEPS``, ``ALL_NODES``).  It says whether it has proved that there is no
packing of the aimed number or has only spent its budget; a ``Plan`` holds its number of sequences,
the bound and whether the number is proved to be the least.  Every piece is packed either way.

Pieces of one length are interchangeable: Spark ranks them (in salted groups, as a third of all
pieces may have one length) and a rank gives the sequence and the offset by binary search.

Defined results: a null text counts as empty and gives one piece of the closing token alone;
repeated rows are packed as often as they occur; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lowtide.llm.storage import bounded_batches, written
from lowtide.llm.text import slices
from lowtide.llm.token_ids import encoded

CAPACITY = 4096
CLOSING_ID = 1
#: fillings tried around one piece, nodes of the walk that finds them, and steps and nodes of a search for one number
FILLINGS, NODES, STEPS, ALL_NODES = 64, 1_000, 8_000, 200_000

Filling = tuple[tuple[int, int], ...]  # (length, pieces of it), longest first


@dataclass(frozen=True)
class Layout:
    """``count`` sequences that all hold this filling."""

    filling: Filling
    count: int


def best_fit(counts: dict[int, int], capacity: int) -> list[Layout]:
    """Best-fit decreasing on a histogram; sequences with equal fillings are handled together."""
    open_: dict[int, list[tuple[Filling, int]]] = defaultdict(list)
    rooms: list[int] = []  # sorted rooms that have open sequences

    def put(filling: Filling, room: int, n: int) -> None:
        if n:
            if not open_[room]:
                insort(rooms, room)
            open_[room].append((filling, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                filling, n = open_[room].pop()
                if not open_[room]:
                    del rooms[at]
            else:
                room, filling, n = capacity, (), left
            each = room // length
            full = min(n, left // each)
            put((*filling, (length, each)), room - each * length, full)
            left -= full * each
            if full < n and left:
                rest = min(left, each)
                put((*filling, (length, rest)), room - rest * length, 1)
                left -= rest
                full += 1
            if filling:
                put(filling, room, n - full)
    return [Layout(f, n) for groups in open_.values() for f, n in groups]


def dominated(chosen: dict[int, int], free: list[int], room: int) -> bool:
    """Whether a fuller filling, or one of fewer pieces, can take the place of this one.

    ``free`` are the lengths of which pieces are left beside the chosen ones, ascending.  A piece that fits
    beside, one that is longer than a chosen one by no more than the room, and one that takes the place of two
    chosen ones each give such a filling: what it drops goes where the new piece was."""
    if free and free[0] <= room:
        return True
    lengths = sorted(chosen)

    def between(low: int, high: int) -> bool:
        at = bisect_left(free, low)
        return at < len(free) and free[at] <= high

    if any(between(x + 1, x + room) for x in lengths):
        return True
    for i, x in enumerate(lengths):
        for y in lengths[i + (chosen[x] < 2) :]:
            if between(x + y, x + y + room):
                return True
    return False


def fillings(
    lengths: list[int], left: dict[int, int], first: int, capacity: int, waste: int, nodes: int = NODES, quick: bool = False
) -> tuple[list[Filling], bool, int]:
    """Undominated fillings that hold ``first``, at most ``waste`` short, fullest first, whether these are all,
    and the nodes that the walk took, at most ``nodes``.  ``quick``: the first ones met, dominated or not.

    The walk goes from long to short.  It turns back where all that is left and fits cannot bring the
    waste down to the limit."""
    found: set[tuple[int, Filling]] = set()
    allowed, whole = nodes, True
    found: set[tuple[int, Filling]] = set()
    neg = int.__neg__
    have = [left[x] - (x == first) for x in lengths]
    smallest = min((x for x, n in zip(lengths, have) if n), default=capacity + 1)
    rest = [0] * (len(lengths) + 1)  # total length of the pieces from a place on
    for i in range(len(lengths) - 1, -1, -1):
        rest[i] = rest[i + 1] + lengths[i] * have[i]

    def record(room: int, chosen: dict[int, int]) -> None:
        if room <= waste:
            total = {**chosen, first: chosen.get(first, 0) + 1}
            free = [x for x in reversed(lengths) if left[x] > total.get(x, 0)]
            if quick or not dominated(chosen, free, room):
                found.add((room, tuple(sorted(total.items(), reverse=True))))

    def walk(at: int, room: int, chosen: dict[int, int]) -> None:
        """Choose the next piece, no longer than the last one."""
        nonlocal nodes, whole
        if nodes <= 0 or quick and len(found) >= FILLINGS:
            whole = False
            return
        nodes -= 1
        if room - rest[at] > waste:
            return
        at = max(at, bisect_left(lengths, -room, key=neg))
        last = True
        for i in range(at, len(lengths)):
            x = lengths[i]
            if chosen.get(x, 0) >= have[i]:
                continue
            if room - x < smallest:  # a last piece: a shorter one in its place is dominated
                if last or quick:
                    record(room - x, {**chosen, x: chosen.get(x, 0) + 1})
                    last = False
                continue
            walk(i, room - x, {**chosen, x: chosen.get(x, 0) + 1})
            last = False
        if last:
            record(room, chosen)

    walk(0, capacity - first, {})
    best = sorted(found, key=lambda x: (x[0], [(-a, -b) for a, b in x[1]]))
    return [f for _, f in best[:FILLINGS]], whole and len(best) <= FILLINGS, allowed - nodes


def complete(counts: dict[int, int], capacity: int, aim: int, quick: bool = False) -> tuple[list[Layout] | None, bool]:
    """Bin completion with at most ``aim`` sequences: the layouts or None, and whether None is proved.

    ``quick`` looks for a packing only: along the first fillings met, each on as many sequences as it can be."""
    total = sum(k * n for k, n in counts.items())
    longest_first = sorted(counts, reverse=True)
    steps, nodes, proved = STEPS, ALL_NODES, not quick
    left = dict(counts)
    # frames of the search: (filling, sequences) still to try, layout put on, waste before
    stack: list[list] = []
    waste, allowed = 0, aim * capacity - total
    if allowed < 0:
        return None, True
    enter = True
    while True:
        if enter:
            lengths = [k for k in longest_first if left[k]]
            if not lengths:
                return [frame[1] for frame in stack], True
            choices, whole, taken = fillings(lengths, left, lengths[0], capacity, allowed - waste, min(NODES, nodes), quick)
            nodes -= taken
            proved &= whole
            tries = []
            for f in choices:
                short = capacity - sum(k * n for k, n in f)
                most = min(left[k] // n for k, n in f)
                if short:
                    most = min(most, (allowed - waste) // short)
                tries += [(f, n, short) for n in dict.fromkeys((most,) if quick else (most, 1)) if n]
            stack.append([tries[::-1], None, waste])
        frame = stack[-1]
        if frame[1] is not None:  # take back what was put on
            for k, n in frame[1].filling:
                left[k] += n * frame[1].count
            frame[1], waste = None, frame[2]
        steps -= 1
        if steps < 0 or nodes <= 0:
            return None, False
        if not frame[0]:
            stack.pop()
            if not stack:
                return None, proved
            enter = False
            continue
        filling, count, short = frame[0].pop()
        for k, n in filling:
            left[k] -= n * count
        frame[1], waste = Layout(filling, count), waste + short * count
        enter = True


@dataclass(frozen=True)
class Plan:
    """Layouts for all pieces, the least number of sequences that any packing needs, and whether
    no packing needs fewer than this one."""

    layouts: list[Layout]
    bound: int
    proved: bool

    @property
    def sequences(self) -> int:
        return sum(x.count for x in self.layouts)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Layouts that hold every piece of the histogram, in as few sequences as the search finds."""
    counts = {int(k): int(n) for k, n in counts.items() if n}
    if not counts:
        return Plan([], 0, True)
    best = best_fit(counts, capacity)
    used = sum(x.count for x in best)
    bound = max(
        -(-sum(k * n for k, n in counts.items()) // capacity),
        sum(n for k, n in counts.items() if 2 * k > capacity),
    )
    while bound < used:
        fewer, certain = complete(counts, capacity, bound)
        if fewer is not None:
            return Plan(fewer, bound, True)
        if not certain:
            break
        bound += 1
    while bound < used - 1:  # the budget went near the bound: come down from above
        fewer = complete(counts, capacity, used - 1, quick=True)[0] or complete(counts, capacity, used - 1)[0]
        if fewer is None:
            break
        best, used = fewer, sum(x.count for x in fewer)
    return Plan(best, bound, bound >= used)


def runs(layouts: list[Layout]) -> np.ndarray:
    """For each run of equal ranks: length, first rank, pieces a sequence, first sequence, offset."""
    rows, taken, sequence = [], defaultdict(int), 0
    for layout in layouts:
        offset = 0
        for length, each in layout.filling:
            rows.append((length, taken[length], each, sequence, offset))
            taken[length] += each * layout.count
            offset += each * length
        sequence += layout.count
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document: key, piece, start, length, ids_crc32."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "piece", "start", "length", "ids_crc32"]
    closing = np.array([CLOSING_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            ids, offsets = encoded(batch.column("_text"), path)
            data, size = memoryview(ids.astype("<u4").tobytes()), np.diff(offsets) + 1
            n = -(-size // capacity)
            doc = np.repeat(np.arange(len(size)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(size[doc] - start, capacity)
            last = start + length == size[doc]
            low = offsets[doc] + start
            high = low + length - last
            crc = np.fromiter((zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(low.tolist(), high.tolist())), np.int64, len(doc))
            crc[last] = [zlib.crc32(closing, c) for c in crc[last].tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key").take(pa.array(doc)), pa.array(piece.astype(np.int32)), *map(pa.array, (start, length, crc))],
                names=names,
            )

    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long"
    return docs.select(docs[key].alias("_key"), docs[text].alias("_text")).mapInArrow(run, schema)


def packed(parts: DataFrame, capacity: int = CAPACITY, salts: int | None = None) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``, and, the same in every row, ``n_sequences``, the number
    that no packing gets below (``least_sequences``) and whether ``n_sequences`` is ``proved_least``.

    The pieces are written once, as both the histogram and the ranks read them.  Two small
    results reach the driver: the histogram (at most ``capacity`` rows) and, from it, the runs."""
    spark = parts.sparkSession
    salts = salts or max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salt = F.pmod(F.xxhash64(*[c for c in parts.columns if c not in ("length", "_salt")]), F.lit(salts)).cast("int")
    parts = written(parts.withColumn("_salt", salt), "pieces")
    groups = parts.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    found = plan(counts, capacity)
    table = runs(found.layouts)
    shared = spark.sparkContext.broadcast(table)
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    first = groups.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    order = Window.partitionBy("length", "_salt").orderBy(*[c for c in parts.columns if c not in ("length", "_salt")])
    ranked = (
        parts.withColumn("_rank", F.row_number().over(order) - 1)
        .join(first, ["length", "_salt"])
        .withColumn("_rank", F.col("_rank") + F.col("_first"))
        .drop("_salt", "_first")
    )
    columns = [c for c in parts.columns if c != "_salt"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        wide = int(rows[:, 1].max(initial=0)) + 1
        for batch in batches:
            length = np.asarray(batch.column("length"), dtype=np.int64)
            rank = np.asarray(batch.column("_rank"), dtype=np.int64)
            # runs are sorted by length, then by first rank
            at = np.searchsorted(rows[:, 0] * wide + rows[:, 1], length * wide + np.minimum(rank, wide - 1), side="right") - 1
            _, begin, each, sequence, offset = rows[at].T
            own = rank - begin
            values = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(
                [*values, pa.array(sequence + own // each), pa.array(offset + own % each * length)],
                names=[*columns, "sequence_id", "offset"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields if f.name != "_salt")
    placed = ranked.select(*columns, F.col("_rank").cast("long")).mapInArrow(run, f"{kinds}, sequence_id long, offset long")
    return placed.withColumns(
        {
            "n_sequences": F.lit(found.sequences).cast("long"),
            "least_sequences": F.lit(found.bound).cast("long"),
            "proved_least": F.lit(found.proved),
        }
    )


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Documents as pieces placed in sequences."""
    return packed(pieces(docs, path, key, text, capacity), capacity)
