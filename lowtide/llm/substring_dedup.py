"""Removal of repeated passages with suffix automata.

A word goes if it lies in a window of ``SPAN`` consecutive words that also starts earlier: in a
document of smaller id, or earlier in the same document.  Windows are judged on the input.

The reference of a window is every earlier window, so the reference is the corpus itself and no
broadcast of its automata has a bound.  It is therefore cut into shards by content: a window's
shard is the hash of its *anchor*, the 8-word gram of least hash in it (the leftmost of equals).
Equal windows have equal anchors and meet in one shard; consecutive windows with one anchor
travel together as one block of text.

1. Of documents with equal texts only the first goes on; all words of the others lie in windows of
   the first (if there is a window at all).  They are found by digests, combined before the
   shuffle, however many there are.
2. A pass over the documents counts anchors in a table of fixed size (2**SKETCH_BITS slots), and a
   second pass counts those whose slot was met twice in another table, which leaves few chance
   meetings.  Bitmaps are broadcast: slots met twice or more, and slots met so often that the
   anchor is hot.  A bitmap has 2**SKETCH_BITS / 8 bytes at every size of the input.
3. A third pass keeps the blocks whose slots were met twice.  Equal blocks of one batch are
   combined, so a passage with very many copies is sent once a batch.  The windows of hot anchors
   are sent one by one under their own hash, as such an anchor may have very many contexts.
4. In each shard blocks come in order of (document, start).  A suffix automaton of the blocks so
   far is streamed over with the next one: where the matching statistic reaches ``SPAN`` words,
   the window that ends there has been met.  A block that brings new windows is added.
5. The maximal spans of each document are joined to it and cut out.  Documents without any are
   kept out of that shuffle by a bitmap of fixed size.

The order of rows is (id, digest of the text, start): rows that repeat both are one document and
lose the same words, rows that share an id alone are taken as different documents.  A null id
comes after all others.  A null text has no words.  An empty table gives an empty result; other
columns are ignored by ``repeats`` and passed through by ``without_repeats``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lowtide.llm.bitmaps import bitmap, held, kept, slot
from lowtide.llm.storage import bounded_batches, plain_names, written
from lowtide.llm.text import Words, hashes, mixed, owners, rolling, slices, split_words, strings, window_starts

SPAN = 20
ANCHOR = 8
SKETCH_BITS = 27
SLICE_BITS = 21
#: an anchor is hot from this count, and from this many times the mean count of a slot
HOT_COUNT, HOT_TIMES = 256, 64
LAST_ID = (1 << 63) - 1
#: text bytes handled at once
SLICE = 2_000_000


class SuffixAutomaton:
    """Suffix automaton of several sequences, with the matching statistics of another one."""

    def __init__(self):
        self.steps: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list) -> None:
        """Add one sequence."""
        steps, link, length = self.steps, self.link, self.length
        last = 0
        for w in words:
            known = steps[last].get(w)
            if known is not None and length[known] == length[last] + 1:
                last = known
                continue
            if known is not None:
                last = self._split(last, w, known)
                continue
            new = len(steps)
            steps.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and w not in steps[p]:
                steps[p][w] = new
                p = link[p]
            if p >= 0:
                q = steps[p][w]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
            last = new

    def _split(self, p: int, w, q: int) -> int:
        """A copy of state q for the strings of length up to that of p with w."""
        steps, link, length = self.steps, self.link, self.length
        copy = len(steps)
        steps.append(dict(steps[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and steps[p].get(w) == q:
            steps[p][w] = copy
            p = link[p]
        return copy

    def matches(self, words: list) -> list[int]:
        """For each place, the length of the longest suffix of the words so far that occurs."""
        steps, link, length = self.steps, self.link, self.length
        state, n, out = 0, 0, []
        for w in words:
            while state and w not in steps[state]:
                state = link[state]
                n = length[state]
            to = steps[state].get(w)
            if to is None:
                n = 0
            else:
                state, n = to, n + 1
            out.append(n)
        return out


def anchored(word: np.ndarray, offsets: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of windows with one anchor: anchor hash, first window start, number of windows."""
    starts = window_starts(offsets, span)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts
    gram = mixed(rolling(word, ANCHOR))
    # the upper half of the hash, then the place: the least is the leftmost of the least hashes
    least = (gram >> np.uint64(32) << np.uint64(32)) | np.arange(len(gram), dtype=np.uint64)
    width = span - ANCHOR + 1
    have = 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    place = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    return gram[place[first]], starts[first], np.diff(np.append(first, len(starts)))


def _word_hashes(words: Words) -> np.ndarray:
    codes, vocabulary = words.encoded()
    return hashes(vocabulary)[codes]


def _slots(anchor: np.ndarray, level: int = 0) -> np.ndarray:
    """Slots of anchors in the table of the first or the second count."""
    other = anchor if level == 0 else mixed(anchor ^ np.uint64(0xD6E8FEB86659FD93))
    return (other >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _doc(key: Column) -> Column:
    return F.coalesce(key.cast("long"), F.lit(LAST_ID))


def _digest(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Order of the document, two digests of its text, and the text."""
    body = F.coalesce(docs[text], F.lit(""))
    return docs.select(
        _doc(docs[key]).alias("_doc"),
        _digest(docs[text]).alias("_digest"),
        F.xxhash64(F.lit("second"), body).alias("_other"),
        docs[text].alias("_text"),
    )


NEVER = -1  # slot of rows that no bitmap leaves out


def _first_texts(keyed: DataFrame) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """Documents, the bitmap whose slots (column ``_slot``) are to be left out of them, and the later
    copies of whole texts (``doc, digest``).

    The first of each group of equal texts is there again as a row that is not left out."""
    names = keyed.select("_doc", "_digest", "_other")
    again = names.groupBy("_digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bits = bitmap(again, F.col("_digest"))
    some = kept(keyed, F.col("_digest"), bits).groupBy("_digest", "_other")
    firsts = written(some.agg(F.min("_doc").alias("_doc"), F.first("_text").alias("_text")), "firsts")
    names_ = ["_doc", "_digest", "_text"]
    others = keyed.select(*names_, slot(F.col("_digest")).alias("_slot"))
    unique = others.union(firsts.select(*names_, F.lit(NEVER).cast("long")))
    first = firsts.select("_digest", "_other", F.col("_doc").alias("_first"))
    copies = kept(names, F.col("_digest"), bits).join(first, ["_digest", "_other"]).where("_doc > _first")
    return unique, bits, copies.select(F.col("_doc").alias("doc"), F.col("_digest").alias("digest")).distinct()


def _passing(batches: Iterator[pa.RecordBatch], bits: np.ndarray, text: str) -> Iterator[pa.RecordBatch]:
    """Slices of the rows whose slot is not in the bitmap."""

    def some() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.asarray(batch.column("_slot"), dtype=np.int64)
            yield batch.filter(pa.array((at < 0) | ~held(bits, np.maximum(at, 0))))

    return slices(some(), text, size=SLICE)


def anchor_bitmaps(
    unique: DataFrame, without: np.ndarray, hot_count: int = HOT_COUNT, within: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the slots met at least twice and of the hot ones, 2**SKETCH_BITS bits each.

    With ``within``, the first result of a count before, only anchors held there are counted, under
    a second hash: this tells chance meetings in the first table from anchors that do repeat."""
    slice_size, level = 1 << SLICE_BITS, int(within is not None)
    shared = unique.sparkSession.sparkContext.broadcast((without, within))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, before = shared.value
        for batch in _passing(batches, bits, "_text"):
            words = split_words(strings(batch.column("_text")))
            anchor = anchored(_word_hashes(words), words.offsets)[0]
            if before is not None:
                anchor = anchor[held(before, _slots(anchor))]
            slot_, n = np.unique(_slots(anchor, level), return_counts=True)
            part, begin = np.unique(slot_ >> SLICE_BITS, return_index=True)
            ends = np.append(begin[1:], len(slot_))
            place, n = (slot_ & (slice_size - 1)).astype(np.uint32), n.astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part.astype(np.int32)),
                    pa.array([place[a:b].tobytes() for a, b in zip(begin, ends)], pa.binary()),
                    pa.array([n[a:b].tobytes() for a, b in zip(begin, ends)], pa.binary()),
                ],
                names=["part", "place", "n"],
            )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by part: one table of counts at a time
        part, counts = None, None

        def done():
            twice = np.packbits(counts >= 2).tobytes()
            hot = np.flatnonzero(counts >= hot_count)
            packed = np.stack((hot, counts[hot])).astype(np.int64).tobytes()
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([int(counts.sum())], pa.int64()), pa.array([twice], pa.binary()), pa.array([packed], pa.binary())],
                names=["part", "total", "twice", "hot"],
            )

        for batch in batches:
            for p, place, n in zip(batch.column("part").to_pylist(), batch.column("place"), batch.column("n")):
                if p != part:
                    if part is not None:
                        yield done()
                    part, counts = p, np.zeros(slice_size, np.int64)
                counts[np.frombuffer(place.as_buffer(), np.uint32)] += np.frombuffer(n.as_buffer(), np.uint32)
        if part is not None:
            yield done()

    counted = unique.select("_text", "_slot").mapInArrow(count, "part int, place binary, n binary")
    merged = counted.repartition("part").sortWithinPartitions("part")
    found = merged.mapInArrow(merge, "part int, total long, twice binary, hot binary").collect()
    n_slices = 1 << (SKETCH_BITS - SLICE_BITS)
    twice = np.zeros((n_slices, slice_size // 8), np.uint8)
    hot = np.zeros(n_slices * slice_size, bool)
    limit = max(hot_count, HOT_TIMES * sum(r["total"] for r in found) >> SKETCH_BITS)
    for r in found:
        twice[r["part"]] = np.frombuffer(r["twice"], np.uint8)
        place, n = np.frombuffer(r["hot"], np.int64).reshape(2, -1)
        hot[(r["part"] << SLICE_BITS) + place[n >= limit]] = True
    return twice.ravel(), np.packbits(hot)


def _joined(words: Words) -> tuple[bytes, np.ndarray]:
    """All words with a space after each, and where each begins."""
    size = np.asarray(pc.binary_length(words.values), dtype=np.int64) + 1
    begin = np.concatenate(([0], np.cumsum(size)))
    body = _lines(words.values, np.array([0, len(words.values)]))[0].as_buffer()
    return bytes(body or b"") + b" ", begin


def _lines(values: pa.Array, offsets: np.ndarray) -> pa.Array:
    """The words of each text joined by spaces."""
    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values.cast(pa.string()))
    return pc.binary_join(lists, " ")


def blocks(unique: DataFrame, without: np.ndarray, hot_count: int = HOT_COUNT) -> DataFrame:
    """Candidate blocks: ``route, text`` with the first place and, packed, the other places."""
    once, _ = anchor_bitmaps(unique, without, hot_count)
    twice, hot = anchor_bitmaps(unique, without, hot_count, within=once)
    shared = unique.sparkSession.sparkContext.broadcast((without, once, twice, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, once, twice, hot = shared.value
        for batch in _passing(batches, bits, "_text"):
            words = split_words(strings(batch.column("_text")))
            word = _word_hashes(words)
            anchor, start, n = anchored(word, words.offsets)
            keep = held(once, _slots(anchor)) & held(twice, _slots(anchor, 1))
            anchor, start, n = anchor[keep], start[keep], n[keep]
            if not len(start):
                continue
            single = held(hot, _slots(anchor, 1))
            if single.any():  # each window of a hot anchor on its own
                each = n[single]
                places = np.repeat(start[single] - (np.cumsum(each) - each), each) + np.arange(each.sum())
                start = np.concatenate((start[~single], places))
                anchor = np.concatenate((anchor[~single], mixed(rolling(word, SPAN)[places] ^ np.uint64(1))))
                n = np.concatenate((n[~single], np.ones(len(places), np.int64)))
            owner = owners(words.offsets)[start]
            doc = np.asarray(batch.column("_doc"), dtype=np.int64)[owner]
            digest = np.asarray(batch.column("_digest"), dtype=np.int64)[owner]
            at = start - words.offsets[owner]
            body, begin = _joined(words)
            order = np.lexsort((at, digest, doc))
            low, high = begin[start].tolist(), (begin[start + n + SPAN - 1] - 1).tolist()
            groups: dict[bytes, list[int]] = {}
            for i in order.tolist():  # in order, so the first of each is the earliest
                groups.setdefault(body[low[i] : high[i]], []).append(i)
            first = np.array([g[0] for g in groups.values()])
            place = np.stack((doc, digest, at), axis=1)
            more = [place[g[1:]].tobytes() if len(g) > 1 else None for g in groups.values()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(anchor[first].view(np.int64)),
                    pa.array(list(groups), pa.binary()),
                    *(pa.array(x[first]) for x in (doc, digest, at)),
                    pa.array(more, pa.binary()),
                ],
                names=["route", "words", "doc", "digest", "start", "more"],
            )

    return unique.mapInArrow(run, "route long, words binary, doc long, digest long, start long, more binary")


def _spans(places: list[int], start: int) -> np.ndarray:
    """Word spans covered by the windows at these places of a block."""
    p = np.array(places, np.int64)
    cut = np.flatnonzero(np.diff(p) > SPAN)
    return np.stack((p[np.append(0, cut + 1)], p[np.append(cut, len(p) - 1)] + SPAN), axis=1) + start


class Shard:
    """The blocks of one route so far; they come in order of their places."""

    def __init__(self, words: bytes):
        self.waiting: bytes | None = words
        self.seen: set[bytes] = set()
        self.automaton = SuffixAutomaton()

    def _insert(self, words: bytes, split: list) -> None:
        self.seen.add(words)
        self.automaton.add(split)

    def met(self, words: bytes) -> list[int]:
        """Places of the windows that were met before; then the block belongs to the shard."""
        if self.waiting is not None:  # most shards have one block and need no automaton
            self._insert(self.waiting, self.waiting.split(b" "))
            self.waiting = None
        split = words.split(b" ")
        if words in self.seen:
            return list(range(len(split) - SPAN + 1))
        found = [i - SPAN + 1 for i, n in enumerate(self.automaton.matches(split)) if n >= SPAN]
        if len(found) < len(split) - SPAN + 1:
            self._insert(words, split)
        return found


def repeated_spans(unique: DataFrame, without: np.ndarray, hot_count: int = HOT_COUNT) -> DataFrame:
    """``doc, digest, spans``: word spans to remove; each document has any number of such rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        route, shard, last, last_met = None, None, None, []
        for batch in batches:
            rows: list[tuple[int, int, bytes]] = []
            columns = [batch.column(c).to_pylist() for c in ("route", "words", "doc", "digest", "start", "more")]
            for r, words, doc, digest, start, more in zip(*columns):
                if r != route:
                    route, shard, last, last_met = r, Shard(words), (doc, digest, start, words), []
                elif (doc, digest, start, words) != last:  # else the row is there twice
                    last, last_met = (doc, digest, start, words), shard.met(words)
                if last_met:
                    rows.append((doc, digest, _spans(last_met, start).tobytes()))
                if more is not None:
                    length = words.count(b" ") + 1
                    for d, g, s in np.frombuffer(more, np.int64).reshape(-1, 3).tolist():
                        if (d, g, s) != (doc, digest, start):
                            rows.append((d, g, np.array([s, s + length], np.int64).tobytes()))
                        elif last_met:
                            rows.append((d, g, _spans(last_met, s).tobytes()))
            if rows:
                doc, digest, spans = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(digest, pa.int64()), pa.array(spans, pa.binary())],
                    names=["doc", "digest", "spans"],
                )

    ordered = blocks(unique, without, hot_count).repartition("route").sortWithinPartitions("route", "doc", "digest", "start")
    return ordered.mapInArrow(run, "doc long, digest long, spans binary")


def _marked(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, np.ndarray]:
    """The documents, all columns, with the packed spans that go (an empty one: all words), and the
    bitmap whose slots (column ``_slot``) are to be left out.

    Only documents that may have spans are joined with them; they are there a second time, without
    a slot."""
    bounded_batches(docs.sparkSession)
    unique, without, copies = _first_texts(_keyed(docs, key, text))
    every = copies.withColumn("spans", F.lit(b""))
    spans = written(repeated_spans(unique, without).union(every), "spans")
    bits = bitmap(spans, F.xxhash64("doc", "digest"))
    spans = spans.groupBy("doc", "digest").agg(F.collect_list("spans").alias("_spans"))
    spans = spans.withColumnsRenamed({"doc": "_span_doc", "digest": "_span_digest"})
    some = kept(docs, F.xxhash64(_doc(docs[key]), _digest(docs[text])), bits)
    doc, digest = _doc(some[key]), _digest(some[text])
    joined = some.join(spans, (doc == F.col("_span_doc")) & (digest == F.col("_span_digest")), "left")
    joined = joined.drop("_span_doc", "_span_digest").withColumn("_slot", F.lit(NEVER).cast("long"))
    name = slot(F.xxhash64(_doc(docs[key]), _digest(docs[text])))
    others = docs.withColumn("_spans", F.lit(None).cast("array<binary>")).withColumn("_slot", name)
    return joined.unionByName(others), bits


def _gone(batch: pa.RecordBatch, words: Words) -> np.ndarray:
    """Whether each word of the batch is removed."""
    total = len(words.values)
    column = batch.column("_spans")
    steps = np.zeros(total + 1, np.int64)
    for i in np.flatnonzero(np.asarray(column.is_valid())):
        parts = column[int(i)].as_py()
        if b"" in parts:  # a copy of a whole text: all words, if they make a window
            n = words.offsets[i + 1] - words.offsets[i]
            parts = [np.array([0, n], np.int64).tobytes()] if n >= SPAN else []
        spans = np.frombuffer(b"".join(parts), np.int64).reshape(-1, 2) + words.offsets[i]
        np.add.at(steps, spans[:, 0], 1)
        np.add.at(steps, spans[:, 1], -1)
    return np.cumsum(steps)[:total] > 0


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_words, n_removed, and the SHA-256 of the kept words joined by spaces."""
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "n_words", "n_removed", "kept_sha256"]

    narrow = docs.select(docs[key].alias("_id"), docs[text].alias("_body"))
    marked, bits = _marked(narrow, "_id", "_body")
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _passing(batches, shared.value, "_body"):
            words = split_words(strings(batch.column("_body")))
            gone = _gone(batch, words)
            kept = np.concatenate(([0], np.cumsum(~gone)))[words.offsets]
            left = _lines(words.values.filter(pa.array(~gone)), kept)
            sha = [hashlib.sha256(x.as_buffer() or b"").hexdigest() for x in left]
            n = words.counts
            columns = [batch.column("_id"), pa.array(n), pa.array(n - np.diff(kept)), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return marked.mapInArrow(run, f"`{key}` {kind}, n_words long, n_removed long, kept_sha256 string")


_WORD = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", chars: str = "n_chars") -> DataFrame:
    """The documents without their repeated passages, all columns kept.

    A removed word takes the white space after it along, so kept lines stay lines.  ``chars``, if
    there is such a column, gets the new length.  A document of which nothing is left goes."""
    own = docs.columns
    docs, (key, text) = plain_names(docs, key, text)
    chars = f"c{own.index(chars)}" if chars in own else ""
    names = docs.columns
    marked, bits = _marked(docs, key, text)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _passing(batches, shared.value, text):
            words = split_words(strings(batch.column(text)))
            gone = _gone(batch, words)
            hit = np.flatnonzero(np.asarray(batch.column("_spans").is_valid()))
            new, left, cut = batch.column(text).to_pylist(), np.ones(batch.num_rows, bool), np.zeros(batch.num_rows, bool)
            for i in hit.tolist():
                own = gone[words.offsets[i] : words.offsets[i + 1]]
                if own.any():
                    body = new[i].encode()
                    head = body[: len(body) - len(body.lstrip(b" \t\n\x0b\x0c\r"))]
                    parts = [w for w, out in zip(_WORD.findall(body), own) if not out]
                    new[i], left[i], cut[i] = (head + b"".join(parts)).decode(), bool(parts), True
            out = pa.array(new, batch.column(text).type)
            columns = [out if c == text else batch.column(c) for c in names]
            if chars in names:
                at = names.index(chars)
                columns[at] = pc.if_else(pa.array(cut), pc.utf8_length(out).cast(columns[at].type), columns[at])
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(left))

    return marked.mapInArrow(run, docs.schema).toDF(*own)
