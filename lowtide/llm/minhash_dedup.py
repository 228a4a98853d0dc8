"""Near-duplicates by an inverted join on signature coordinates.

1. Every text becomes the set of its 5-word shingles (64-bit hashes) and a signature of 64 minima.
   Texts with equal sets form one class, found by one aggregate; only one row a class goes on.
2. Each class is posted under the coordinate-value pairs of its signature.  Two sets that agree in
   at least T of K coordinates share a pair among the first K - T + 1 of *any* common order of the
   pairs, so only this prefix is posted, rarest pairs first: long lists are skipped unless nearly
   the whole signature lies in long lists.
3. The agreeing coordinates of pairs that meet are counted, and at least T are asked for.  Members
   of lists of up to ``SHORT`` classes meet each other.  In longer lists each member meets the
   class of the earliest document only.  Pairs with enough agreement are confirmed on their full
   sets, and the links give components.
4. Members of one long list may still lie in different components.  ``MORE`` further pairs are posted
   a class, so two sets that agree enough share 1 + MORE pairs among those posted; had they not met, all of these
   are long lists with members of several components.  Only classes with so many such lists go on, which a
   passage that many documents share does not bring about.  For those the set itself
   serves as the signature: each shingle is a coordinate, and the prefix is the exact one that
   Jaccard similarity asks for (the first shingles, rarest first, of which two similar sets of
   these sizes must share one).  One row a shingle of the prefix is written; those that only one component
   has are dropped by an aggregate, and the rest is asked for only in the size classes that occur under
   the shingle.  A member of a large group of near copies that is too far from the
   others has a prefix of shingles of its own and meets nobody, so the work follows the members
   and not their pairs, and no link between components is lost.

Every link is exact.  The similarity limit is a parameter, in percent, and T follows from it: the
largest T of which a pair at the limit falls short with a chance of at most ``MISSED``.  At 0.85
that is 42 of 64 coordinates; a pair at 0.9 then falls short with a chance of 3e-8.

Components are found by alternating stars.  What reaches the driver has a fixed size: counts, the
table of the most frequent pairs (at most ``HOT_PAIRS`` entries), a bitmap of wanted documents and
a table of shingle frequencies (one byte for each of 2**TABLE_BITS slots).

Defined results: a null text or one without words has an empty set and is linked with nothing;
one of fewer than five words is one shingle; repeated rows are one class.  Rows without an id are
linked as all others and take the component of their class, but are never its smallest id; a
component of only such rows has none, and one row of the least digest is kept of it.
Rows that share an id but not the text are separate documents whose component is found by text.
An empty table gives an empty result; other columns are ignored by ``near_duplicates`` and passed
through by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lowtide.llm.bitmaps import bitmap, kept
from lowtide.llm.graph import components
from lowtide.llm.storage import bounded_batches, written
from lowtide.llm.text import hashes, mixed, rolling, slices, split_words, strings

WORDS = 5
#: the limit of the contract of op4
SIMILARITY_PCT = 85
COORDINATES = 64
#: chance at most with which the signature misses a pair at the limit
MISSED = 5e-5
#: most entries of the table of frequent pairs
HOT_PAIRS = 1 << 17
#: members of a list that all meet each other
SHORT = 8
#: pairs posted beyond those of which similar sets share one
MORE = 6
#: slots of the table of shingle frequencies
TABLE_BITS = 24
#: ratio of neighbouring size classes
SIZE_STEP = 1.02
#: shingles hashed at once for a signature
BLOCK = 1 << 14

_STEP = mixed(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTOR, _SHIFT = _STEP[:COORDINATES] | np.uint64(1), _STEP[COORDINATES:]


def agreement(pct: int) -> int:
    """Coordinates in which a pair at this similarity agrees, but for a chance of at most MISSED."""
    p, chance = pct / 100, 0.0
    for t in range(COORDINATES + 1):
        chance += comb(COORDINATES, t) * p**t * (1 - p) ** (COORDINATES - t)
        if chance > MISSED:
            return max(t, 1)
    return COORDINATES


def shingle_sets(texts: pa.Array, size: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text of an Arrow array."""
    words = split_words(pc.ascii_lower(strings(texts)))
    codes, vocabulary = words.encoded()
    word = hashes(vocabulary)[codes]
    shingle = mixed(rolling(word, size)) if len(word) >= size else np.zeros(0, np.uint64)
    for a, b in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist()):
        if b - a >= size:
            yield np.unique(shingle[a : b - size + 1])
        elif b > a:  # marked by the number of words, so as not to equal a longer one's shingle
            yield mixed(rolling(word[a:b], b - a) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum of each of the hash functions over a set, as 32-bit numbers."""
    low = None
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), BLOCK):
            values = shingles[i : i + BLOCK, None] * _FACTOR + _SHIFT
            found = (values >> np.uint64(32)).min(axis=0)
            low = found if low is None else np.minimum(low, found)
    return low.astype(np.uint32)


def set_key(shingles: np.ndarray) -> int:
    """64-bit name of a set."""
    with np.errstate(over="ignore"):
        total = mixed(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(mixed(np.array([total + np.uint64(len(shingles))], np.uint64)).view(np.int64)[0])


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: ``doc_id``, digest of the text, ``n_shingles, node`` (name of the set, null if empty), ``sig``."""
    kind = docs.schema[key].dataType.simpleString()
    names = ["doc_id", "digest", "n_shingles", "node", "sig"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            n, node, sig = [], [], []
            for s in shingle_sets(batch.column("_text")):
                n.append(len(s))
                node.append(set_key(s) if len(s) else None)
                sig.append(signature(s).tobytes() if len(s) else None)
            columns = [batch.column("_key"), batch.column("_digest"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {kind}, digest long, n_shingles long, node long, sig binary"
    return docs.select(docs[key].alias("_key"), _digest(docs[text]).alias("_digest"), docs[text].alias("_text")).mapInArrow(run, schema)


def _digest(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array([np.frombuffer(x, np.uint32) for x in column.to_pylist()], np.uint32).reshape(-1, COORDINATES)


def _pair_names(sigs: np.ndarray) -> np.ndarray:
    """Coordinate and value of every signature entry as one number."""
    return (np.arange(COORDINATES, dtype=np.int64) << 32) | sigs.astype(np.int64)


def frequent_pairs(classes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent coordinate-value pairs and their counts, sorted by pair.

    A pair counts as frequent from a count that at most HOT_PAIRS pairs can reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, n = np.unique(_pair_names(_matrix(batch.column("sig"))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n.astype(np.int64))], names=["pair", "n"])

    least = max(8, -(-classes.count() * COORDINATES // HOT_PAIRS))
    counts = classes.select("sig").mapInArrow(run, "pair long, n long")
    found = counts.groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toPandas()
    found = found.sort_values("pair")
    return found["pair"].to_numpy(np.int64), found["n"].to_numpy(np.int64)


def postings(classes: DataFrame, pct: int) -> DataFrame:
    """``pair, rep, node, n_shingles`` for the prefix of every class."""
    posted = min(COORDINATES, COORDINATES - agreement(pct) + 1 + MORE)
    pairs, counts = frequent_pairs(classes)
    shared = classes.sparkSession.sparkContext.broadcast((pairs, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, times = shared.value
        for batch in batches:
            name = _pair_names(_matrix(batch.column("sig")))
            times_of = np.zeros(name.shape, np.int64)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, name), len(hot) - 1)
                times_of = np.where(hot[at] == name, times[at], 0)
            order = np.lexsort((mixed(name.astype(np.uint64)), times_of), axis=1)[:, :posted]
            chosen = np.take_along_axis(name, order, axis=1)
            row = pa.array(np.repeat(np.arange(len(name)), posted))
            rest = [batch.column(c).take(row) for c in ("rep", "node", "n_shingles")]
            yield pa.RecordBatch.from_arrays([pa.array(chosen.ravel()), *rest], names=["pair", "rep", "node", "n_shingles"])

    kind = classes.schema["rep"].dataType.simpleString()
    schema = f"pair long, rep {kind}, node long, n_shingles long"
    return classes.select("rep", "node", "n_shingles", "sig").mapInArrow(run, schema)


def _agreeing(pairs: DataFrame, classes: DataFrame, pct: int) -> DataFrame:
    """The pairs whose signatures agree in enough coordinates."""
    agree = agreement(pct)
    left = classes.select(F.col("node").alias("a"), F.col("sig").alias("_a"))
    right = classes.select(F.col("node").alias("b"), F.col("sig").alias("_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = (_matrix(batch.column("_a")) == _matrix(batch.column("_b"))).sum(axis=1)
            yield batch.filter(pa.array(same >= agree)).select(["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "_a", "_b").mapInArrow(run, "a long, b long")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def _confirmed(pairs: DataFrame, texts: DataFrame, pct: int) -> DataFrame:
    """The pairs whose full sets are similar enough.

    Texts travel instead of sets, which take several times their space."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_a", "_b"):
            keep = []
            for x, y in zip(shingle_sets(batch.column("_a")), shingle_sets(batch.column("_b"))):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= pct * (len(x) + len(y) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "_a", "_b").mapInArrow(compare, "a long, b long")


def _frequencies(members: DataFrame) -> np.ndarray:
    """For each slot of the shingles' hashes, about 8 log2 of 1 + their number, in a byte."""
    parts, size = 64, (1 << TABLE_BITS) // 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            all_ = np.concatenate([np.zeros(0, np.uint64), *shingle_sets(batch.column("text"))])
            slot, n = np.unique((all_ >> np.uint64(64 - TABLE_BITS)).astype(np.uint32), return_counts=True)
            part, begin = np.unique(slot // size, return_index=True)
            ends = np.append(begin[1:], len(slot))
            cut = lambda x, begin=begin, ends=ends: pa.array([x[a:b].tobytes() for a, b in zip(begin, ends)], pa.binary())
            columns = [pa.array(part.astype(np.int32)), cut((slot % size).astype(np.uint32)), cut(n.astype(np.uint32))]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "place", "n"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = None, None  # rows come sorted by part

        def done() -> pa.RecordBatch:
            level = np.minimum(np.ceil(8 * np.log2(1.0 + total)), 255).astype(np.uint8)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["part", "level"])

        for batch in batches:
            for p, place, n in zip(batch.column("part").to_pylist(), batch.column("place"), batch.column("n")):
                if p != part:
                    if part is not None:
                        yield done()
                    part, total = p, np.zeros(size, np.int64)
                total[np.frombuffer(place.as_buffer(), np.uint32)] += np.frombuffer(n.as_buffer(), np.uint32)
        if part is not None:
            yield done()

    counted = members.select("text").mapInArrow(count, "part int, place binary, n binary")
    merged = counted.repartition("part").sortWithinPartitions("part").mapInArrow(merge, "part int, level binary")
    table = np.zeros((parts, size), np.uint8)
    for r in merged.collect():
        table[r["part"]] = np.frombuffer(r["level"], np.uint8)
    return table.ravel()


def _exact_postings(members: DataFrame, pct: int) -> DataFrame:
    """``shingle, node, root, n, place`` of the exact prefixes: a row a shingle that a set may have to share."""
    shared = members.sparkSession.sparkContext.broadcast(_frequencies(members))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        once = int(np.ceil(8 * np.log2(2.0)))
        for batch in slices(batches, "text", size=1_000_000):
            row, shingle, size, place = [], [], [], []
            for i, s in enumerate(shingle_sets(batch.column("text"))):
                n, level = len(s), levels[(s >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
                order = np.lexsort((s, level))[: n - -(-pct * n // 100) + 1]
                # a shingle alone in its slot is in no other set, but it has its place
                places = np.flatnonzero(level[order] > once)
                row.append(np.full(len(places), i))
                shingle.append(s[order][places].view(np.int64))
                size.append(np.full(len(places), n))
                place.append(places)
            at = pa.array(np.concatenate(row).astype(np.int64))
            columns = [pa.array(np.concatenate(x).astype(np.int64)) for x in (shingle, size, place)]
            yield pa.RecordBatch.from_arrays(
                [columns[0], batch.column("node").take(at), batch.column("root").take(at), *columns[1:]],
                names=["shingle", "node", "root", "n", "place"],
            )

    return members.select("node", "root", "text").mapInArrow(run, "shingle long, node long, root long, n long, place long")


def _between_components(members: DataFrame, pct: int) -> DataFrame:
    """Pairs of members in different components that may be similar by the exact prefixes.

    A set lies under its own size class; it asks in each class of sets that are no larger and may
    still be similar, with the prefix that the smallest size of the class allows."""
    posted = written(_exact_postings(members, pct), "exact")
    shared = posted.groupBy("shingle").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low <> _high")
    posted = written(posted.join(shared.select("shingle"), "shingle", "left_semi"), "shared")

    def least(x: Column, y: Column) -> Column:
        return F.ceil(F.lit(pct) * (x + y) / F.lit(100 + pct))

    def size_class(n: Column) -> Column:
        return F.floor(F.log(n) / F.lit(float(np.log(SIZE_STEP))) + F.lit(1e-9)).cast("int")

    n, place = F.col("n"), F.col("place")
    index = posted.where(place < n - least(n, n) + 1)
    index = index.select("shingle", size_class(n).alias("size_class"), *[F.col(c).alias(f"_{c}") for c in ("node", "root", "n", "place")])
    classes = index.groupBy("shingle", "size_class").agg(F.min("_n").alias("_smallest"))
    asked = posted.join(classes, "shingle").where(F.col("_smallest") <= n)
    smallest = F.greatest(F.col("_smallest"), F.ceil(F.lit(pct) * n / 100))
    asked = asked.where((size_class(n) >= F.col("size_class")) & (size_class(F.ceil(F.lit(pct) * n / 100)) <= F.col("size_class")))
    asked = asked.where(place < n - least(n, smallest) + 1)
    met = asked.join(index, ["shingle", "size_class"])
    met = met.where("root <> _root AND n >= _n AND (n > _n OR node > _node)")
    met = met.where(F.least(n - place, F.col("_n") - F.col("_place")) >= least(n, F.col("_n")))
    return met.select(F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b")).distinct()


def _fetched(docs: DataFrame, ids: DataFrame, key: str, text: str) -> DataFrame:
    """``node, text`` of the wanted classes (columns ``node, rep, digest``).

    Classes without an id are found by the digest of one of their texts; repeated rows of it are
    combined before the shuffle.
    A class has more than one row only if rows share its id and differ in text but not in its set.
    A bitmap keeps most other documents out of the shuffle; the join is what decides."""
    rows = docs.select(docs[key].alias("rep"), docs[text].alias("text"))
    named, unnamed = ids.where("rep IS NOT NULL").select("node", "rep"), ids.where("rep IS NULL").select("node", "digest")
    body = kept(rows.where("rep IS NOT NULL"), F.xxhash64("rep"), bitmap(named, F.xxhash64("rep")))
    # repeated rows fall together where the join has put them
    found = body.join(named, "rep").withColumn("_digest", F.xxhash64("text")).dropDuplicates(["rep", "node", "_digest"])
    body = rows.where("rep IS NULL").select(_digest(F.col("text")).alias("digest"), "text")
    body = kept(body, F.xxhash64("digest"), bitmap(unnamed, F.xxhash64("digest")))
    rest = body.groupBy("digest").agg(F.min("text").alias("text")).join(unnamed, "digest")
    return written(_own_text(found.select("node", "text").union(rest.select("node", "text"))), "texts")


def _fits(small: str, large: str, pct: int) -> Column:
    """Whether the sizes of two sets allow the similarity."""
    return F.least(small, large) * 100 >= F.greatest(small, large) * pct


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", pct: int = SIMILARITY_PCT) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept`` and the digest of its text.

    Sets of a similarity of at least ``pct`` percent are linked."""
    bounded_batches(docs.sparkSession)
    rows = written(signatures(docs, key, text).withColumn("row", F.monotonically_increasing_id()), "signatures")
    found = rows.where("node IS NOT NULL").groupBy("node")
    classes = found.agg(
        F.min("doc_id").alias("rep"),
        F.max("n_shingles").alias("n_shingles"),
        F.max("sig").alias("sig"),
        F.min("digest").alias("digest"),
        F.min(F.when(F.col("doc_id").isNull(), F.struct("digest", "row"))).alias("unnamed"),
    )
    classes = written(classes, "classes")
    posted = postings(classes, pct)
    lists = (
        posted.groupBy("pair")
        .agg(
            F.count(F.lit(1)).alias("members"),
            F.min(F.struct(F.col("rep").isNull().alias("unnamed"), "rep", "node", "n_shingles")).alias("first"),
            F.min("n_shingles").alias("_least"),
            F.max("n_shingles").alias("_most"),
        )
        .where("members > 1")
        .where((F.col("members") > 2) | _fits("_least", "_most", pct))
        .drop("_least", "_most")
    )
    posted = written(posted.drop("rep").join(lists, "pair"), "postings")

    short = posted.where(F.col("members") <= SHORT).select("pair", F.col("node").alias("a"), "n_shingles")
    other = short.select("pair", F.col("a").alias("b"), F.col("n_shingles").alias("_size"))
    met = short.join(other, "pair").where("a < b").where(_fits("n_shingles", "_size", pct)).select("a", "b")
    long = posted.where(F.col("members") > SHORT)
    stars = long.where("node <> first.node").where(_fits("n_shingles", "first.n_shingles", pct))
    stars = stars.select(F.least("first.node", "node").alias("a"), F.greatest("first.node", "node").alias("b"))
    found = written(_agreeing(met.union(stars).distinct(), classes, pct), "agreeing")

    # the texts of all classes that may be asked for, fetched once
    listed = long.groupBy("node").agg(F.count(F.lit(1)).alias("lists")).where(F.col("lists") > MORE).select("node")
    ends = _ends(found)
    texts = _fetched(docs, ends.union(listed).distinct().join(classes.select("node", "rep", "digest"), "node"), key, text)
    links = written(_confirmed(found, kept(texts, F.xxhash64("node"), bitmap(ends, F.xxhash64("node"))), pct), "links")
    roots = components(links)

    apart = long.select("pair", "node").join(listed, "node", "left_semi").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed_lists = apart.groupBy("pair").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low <> _high")
    apart = apart.join(mixed_lists.select("pair"), "pair", "left_semi").groupBy("node").agg(F.max("root").alias("root"), F.count(F.lit(1)).alias("lists"))
    apart = apart.where(F.col("lists") > MORE).select("node", "root")
    members = written(texts.join(apart, "node"), "members")
    late = written(_between_components(members, pct), "late")
    bits = bitmap(_ends(late), F.xxhash64("node"))
    links = written(links.union(_confirmed(late, kept(texts, F.xxhash64("node"), bits), pct)), "links")
    roots = components(links)

    named = classes.select("node", "rep", "unnamed").join(roots, "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"), F.min("unnamed")["row"].alias("_first"))
    named = named.join(least, "root").select("node", "component_id", "_first")
    own = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("doc_id").isNotNull() | (F.col("row") == F.col("_first")))
    return (
        rows.select("doc_id", "digest", "n_shingles", "node", "row")
        .join(named, "node", "left")
        .select(
            F.col("doc_id").alias(key),
            "n_shingles",
            F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
            F.when(F.col("node").isNull(), F.lit(True)).otherwise(own).alias("kept"),
            "digest",
        )
    )


def _own_text(texts: DataFrame) -> DataFrame:
    """Texts that are of their class: rows that share an id may bring others, which are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            name = batch.column("node").to_pylist()
            own = [len(s) > 0 and set_key(s) == n for s, n in zip(shingle_sets(batch.column("text")), name)]
            yield batch.filter(pa.array(own, pa.bool_()))

    return texts.mapInArrow(run, texts.schema)


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", pct: int = SIMILARITY_PCT) -> DataFrame:
    """The documents with the smallest id of their component, all columns unchanged.

    Rows that repeat a kept document's id and text stay too: they are the same document.  Of a
    component of rows without an id one row stays."""
    found = near_duplicates(docs, key, text, pct).where("kept")
    alone = F.col(key).isNull() & (F.col("n_shingles") > 0)
    keep = found.select(F.col(key).alias("_keep"), F.col("digest").alias("_kept_digest"), alone.alias("_alone")).distinct()
    keep = written(keep, "kept")
    same = docs[key].eqNullSafe(keep["_keep"]) & (_digest(docs[text]) == keep["_kept_digest"])
    stay = docs.join(keep.where("NOT _alone"), same, "left_semi")
    ones = keep.where("_alone").select("_kept_digest")
    unnamed = docs.where(docs[key].isNull()).select(F.struct("*").alias("_row"), _digest(docs[text]).alias("_kept_digest"))
    unnamed = unnamed.join(ones, "_kept_digest", "left_semi").groupBy("_kept_digest").agg(F.first("_row").alias("_row"))
    return stay.union(unnamed.select("_row.*"))
