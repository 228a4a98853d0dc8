"""Alignment of the tokens of two tokenizers, and how often ids are linked over the whole corpus.

Tokenizer A (byte-level BPE of the tokenizers library) encodes a space and the text, B (a
sentence-piece model, which puts a space mark before a text) encodes the text, so the tokens of both spell
the same bytes.  The cumulative ends of A's tokens and of B's are put into dictionaries from end to index;
the intersection of the two key sets, sorted, slices both id lists into groups, and the links of a group are
all its A-B pairs.

Both tokenizers begin a new token at a space between two characters that are no white space: A's
pre-tokenizer takes such a space as the first character of a token, and no piece of B holds a space mark after another
character.  So both end a token there, groups never reach across, and a text is the sequence of its segments between
these places.  Both properties are proved from the files (``cuts``); for other tokenizers the whole text is one segment.
A worker aligns the distinct segments that it has not met yet, many at a time as one text, and keeps what it found of
each in a bounded cache.

The distinct linked pairs of each document are written once.  How many documents hold a pair is counted from them,
combined within each task.  The most
frequent pairs (at most HOT_PAIRS, as many as fit) are broadcast and looked up in place; only the other,
rare pairs of each document are joined with their counts by a shuffle.  A rare pair occurs in few documents, so no
key of that join is hot, and what is shuffled is the tail of the counts.  The highest count of an A id
is found among its pairs, at most as many as B has ids.

Defined results: null and empty texts, and texts whose joined token bytes differ from the space and the text (those
holding U+2581, for B), have no tokens, zeros and an empty ``groups_sha256``; repeated rows are documents each, with or
without an id; an empty table gives an empty result; other columns are ignored.  A segment without any inner cut, however
long, is aligned whole; its links are counted by distinct ids, never written out.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lowtide.llm import token_counts
from lowtide.llm.storage import bounded_batches, written
from lowtide.llm.text import Words, slices, strings, sums
from lowtide.llm.token_counts import MARK
from lowtide.llm.token_ids import IdCache

#: most pairs that are broadcast with their counts
HOT_PAIRS = 1 << 19
#: pairs a task gathers before it passes them on
GATHERED = 1 << 20
#: segments, and pairs of segments, kept by a worker
CACHE_SEGMENTS, CACHE_PAIRS = 400_000, 4_000_000
#: characters of new segments that are aligned together
TOGETHER_CHARS = 200_000
#: links of a group up to which they are written out
WRITTEN_OUT = 4096

#: white space, and segments of the blocks up to Latin Extended-B only
WHITE = "[\t-\r\x1c-\x20\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
KNOWN = "^[\x00-\u024f]*$"


def byte_of_char() -> dict[str, int]:
    """Byte that each character of a byte-level vocabulary stands for: printable Latin-1 bytes stand for
    themselves, the others follow from 256 on in their order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices behind the tokens of A and of B that end at the same byte, in order."""
    index_a = dict(zip(ends_a.tolist(), range(1, len(ends_a) + 1)))
    index_b = dict(zip(ends_b.tolist(), range(1, len(ends_b) + 1)))
    both = sorted(index_a.keys() & index_b.keys())
    return np.array([index_a[e] for e in both], np.int64), np.array([index_b[e] for e in both], np.int64)


def links(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, pair and number of links of the linked id pairs of each group, whose ids end at the cuts.

    The pairs of a group are written out, but those of a group of very many by distinct ids."""
    start_a, start_b = np.concatenate(([0], cut_a[:-1])), np.concatenate(([0], cut_b[:-1]))
    n_a, n_b = cut_a - start_a, cut_b - start_b
    size = n_a * n_b
    large = np.flatnonzero(size > WRITTEN_OUT)
    size[large] = 0
    group = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size)
    x = a[start_a[group] + at // np.maximum(n_b[group], 1)]
    y = b[start_b[group] + at % np.maximum(n_b[group], 1)]
    parts = [(group, x << 32 | y, np.ones(len(group), np.int64))]
    for g in large.tolist():
        ids_a, times_a = np.unique(a[start_a[g] : cut_a[g]], return_counts=True)
        ids_b, times_b = np.unique(b[start_b[g] : cut_b[g]], return_counts=True)
        pair, times = (ids_a[:, None] << 32 | ids_b).ravel(), np.outer(times_a, times_b).ravel()
        parts.append((np.full(len(pair), g), pair, times))
    return tuple(np.concatenate(p) for p in zip(*parts))


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and whether texts may be cut into segments."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        byte = byte_of_char()
        names = {i: t for t, i in self.a.get_vocab().items()}
        raw = [names.get(i, "") for i in range(max(names) + 1)]
        self.bytes_a = [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in raw]
        self.b, stable = token_counts.load(path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)
        ]
        made = json.loads(self.a.to_str())
        before = made.get("pre_tokenizer") or {}
        by_words = before.get("type") == "ByteLevel" and before.get("use_regex", True)
        self.cuts = stable and bool(by_words) and made.get("normalizer") is None
        self.fast = self._ranked(made["model"]) if self.cuts else None

        self.size_a = np.array([len(x) for x in self.bytes_a])
        self.size_b = np.array([len(x) for x in self.bytes_b])
        most = max(len(self.bytes_a), len(self.bytes_b))
        self.digits = pa.array([str(i) for i in range(most)], pa.large_string())

    def _ranked(self, model: dict):
        """A as an encoder by ranks, which is faster: the same if merges make the ids in their order."""
        vocabulary = model.get("vocab") or {}
        added = set(self.a.get_added_tokens_decoder())
        ranks = {self.bytes_a[i]: i for i in vocabulary.values() if i not in added}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges") or []]
        first = len(ranks) - len(pairs)
        made = [vocabulary.get("".join(p)) for p in pairs]
        if first != 256 or made != list(range(first, len(ranks))) or model.get("dropout") or model.get("ignore_merges"):
            return None
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, segments: list[str], known: bool = False) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both for the segments joined by spaces; None where the bytes differ from a space and that text.

        As both end a token before every such space, these are the ids of the segments one by one.
        ``known``: all characters are of the blocks that every version of Unicode classes alike."""
        text = " ".join(segments)
        if known and self.fast is not None:
            a = self.fast.encode_ordinary(" " + text)
        else:
            a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text, num_threads=1)
        want = (" " + text).encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) == want == b"".join(map(self.bytes_b.__getitem__, b)):
            return np.array(a, np.int64), np.array(b, np.int64)
        return None


class Aligned(IdCache):
    """Figures of the distinct segments that a worker has met: tokens of A and B, groups, links, whether
    the bytes are right, the groups as text, and the linked pairs with how often each is linked."""

    def __init__(self, tokenizers: Tokenizers, limit: int = CACHE_SEGMENTS):
        self.tokenizers = tokenizers
        super().__init__(limit)

    def _clear(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.text = pa.array([], pa.large_string())
        self.figures = np.zeros((0, 5), np.int64)  # n_a, n_b, n_groups, n_links, bad
        self.start = np.zeros(1, np.int64)
        self.place = np.zeros(0, np.int64)  # of each linked pair in ``pairs``
        self.times = np.zeros(0, np.int64)
        self.pairs = np.zeros(0, np.int64)
        self._place_of: dict[int, int] = {}

    def numbers(self, vocabulary: pa.Array) -> np.ndarray:
        if len(self.place) > CACHE_PAIRS:
            self._clear()
        return super().numbers(vocabulary)

    def _add(self, words: pa.Array) -> None:
        # a segment with white space at an end, as of the ends of a text, can have no neighbour
        alone = np.asarray(pc.match_substring_regex(words, f"^$|^{WHITE}|{WHITE}$|{MARK}"))
        known = np.asarray(pc.match_substring_regex(words, KNOWN)) & ~alone
        order = []
        for chosen in (known, ~known & ~alone):
            names = words.filter(pa.array(chosen)).to_pylist()
            size = np.cumsum([len(w) for w in names])
            start = 0
            while start < len(names):
                stop = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + TOGETHER_CHARS)))
                self._add_some(names[start:stop], chosen is known)
                start = stop
            order += names
        rest = words.filter(pa.array(alone)).to_pylist()
        for w in rest:
            self._add_some([w])
        self.known = pa.concat_arrays([self.known, pa.array(order + rest, pa.large_string())])

    def _add_some(self, names: list[str], known: bool = False) -> None:
        """Figures of new segments, aligned together as one text."""
        both = self.tokenizers.encode(names, known) if self.tokenizers.cuts or len(names) == 1 else None
        if both is None and len(names) > 1:  # one of them is not spelt by its tokens, or they have to stay apart
            half = len(names) // 2
            self._add_some(names[:half], known)
            self._add_some(names[half:], known)
            return
        if both is None:
            self._append(np.array([[0, 0, 0, 0, 1]]), pa.array([""], pa.large_string()), *[np.zeros(0, np.int64)] * 3)
            return
        a, b = both
        t = self.tokenizers
        ends_a, ends_b = np.cumsum(t.size_a[a]), np.cumsum(t.size_b[b])
        cut_a, cut_b = common_ends(ends_a, ends_b)
        ends = np.cumsum([len(w.encode()) + 1 for w in names])
        behind = [np.searchsorted(e, ends, side="right") for e in (ends_a, ends_b, ends_a[cut_a - 1])]
        n_a, n_b, n_groups = (np.diff(x, prepend=0) for x in behind)
        group, pair, times = links(a, b, cut_a, cut_b)
        segment = np.searchsorted(behind[2], group, side="right")
        n_links = np.bincount(segment, times, len(names)).astype(np.int64)
        # the groups as text: ids by commas, sides by a bar, groups by semicolons
        sides = [self._joined(t.digits.take(pa.array(x)), np.concatenate(([0], cut)), ",") for x, cut in ((a, cut_a), (b, cut_b))]
        text = self._joined(pc.binary_join_element_wise(*sides, pa.scalar("|", pa.large_string())), np.concatenate(([0], behind[2])), ";")
        # distinct pairs of each segment
        number, at = np.unique(pair, return_inverse=True)
        key = segment * max(len(number), 1) + at
        order = np.argsort(key, kind="stable")
        key, times = key[order], times[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        times = np.add.reduceat(times, first) if len(first) else times
        segment, at = np.divmod(key[first], max(len(number), 1))
        place = [self._place_of.setdefault(p, len(self._place_of)) for p in number.tolist()]
        fresh = np.array(place, np.int64) >= len(self.pairs)
        self.pairs = np.concatenate((self.pairs, number[fresh]))
        figures = np.stack((n_a, n_b, n_groups, n_links, np.zeros(len(names), np.int64)), axis=1)
        self._append(figures, text, np.bincount(segment, minlength=len(names)), np.array(place, np.int64)[at], times)

    @staticmethod
    def _joined(values: pa.Array, offsets: np.ndarray, separator: str) -> pa.Array:
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values), pa.scalar(separator, pa.large_string()))

    def _append(self, figures: np.ndarray, text: pa.Array, size: np.ndarray, place: np.ndarray, times: np.ndarray) -> None:
        if not len(size):
            size = np.zeros(len(figures), np.int64)
        self.text = pa.concat_arrays([self.text, text])
        self.figures = np.concatenate((self.figures, figures))
        self.start = np.concatenate((self.start, self.start[-1] + np.cumsum(size)))
        self.place = np.concatenate((self.place, place))
        self.times = np.concatenate((self.times, times))


def segments(texts: pa.Array, cuts: bool) -> Words:
    """Segments of every text, each without its first space; an empty text has none."""
    empty = np.asarray(pc.binary_length(texts)) == 0
    kept = texts.filter(pa.array(~empty))
    if not cuts:
        return Words(kept, np.concatenate(([0], np.cumsum(~empty))))
    lists = pc.split_pattern(kept, " ")
    offsets = np.asarray(lists.offsets, dtype=np.int64) if len(kept) else np.zeros(1, np.int64)
    offsets = offsets - offsets[0]
    parts = lists.flatten()
    # a space is a cut unless white space, or an end of the text, stands beside it
    codes = parts.dictionary_encode()
    number = np.asarray(codes.indices, dtype=np.int64)
    first, last = (np.asarray(pc.match_substring_regex(codes.dictionary, x))[number] for x in (f"^$|^{WHITE}", f"^$|{WHITE}$"))
    begins = np.ones(len(parts), bool)
    begins[1:] = ~first[1:] & ~last[:-1]
    begins[offsets[:-1]] = True
    if not begins.all():
        cut = np.append(np.flatnonzero(begins), len(parts)).astype(np.int32)
        parts = pc.binary_join(pa.ListArray.from_arrays(pa.array(cut), parts), pa.scalar(" ", parts.type))
        offsets = np.concatenate(([0], np.cumsum(begins)))[offsets]
    count = np.zeros(len(texts), np.int64)
    count[~empty] = np.diff(offsets)
    return Words(parts, np.concatenate(([0], np.cumsum(count))))


_CACHES: dict[tuple[str, str], Aligned] = {}


def load(path_a: str, path_b: str) -> Aligned:
    """The tokenizers and their cache, once per worker."""
    if (path_a, path_b) not in _CACHES:
        _CACHES[path_a, path_b] = Aligned(Tokenizers(path_a, path_b))
    return _CACHES[path_a, path_b]


class Slice:
    """Alignment of some texts."""

    def __init__(self, texts: pa.Array, cache: Aligned):
        words = segments(strings(texts), cache.tokenizers.cuts)
        codes, vocabulary = words.encoded()
        number = cache.numbers(vocabulary)[codes] if len(vocabulary) else np.zeros(0, np.int64)
        figures = cache.figures[number]
        totals = [sums(figures[:, i], words.offsets) for i in range(5)]
        self.bad = (totals[4] > 0) | (words.counts == 0)
        self.figures = [np.where(self.bad, 0, t) for t in totals[:4]]
        self.joined = cache._joined(cache.text.take(pa.array(number)), words.offsets, ";")
        # distinct pairs of each document, by their places in the cache
        used = ~np.repeat(self.bad, words.counts)
        doc, number = np.repeat(np.arange(len(self.bad)), words.counts)[used], number[used]
        length = cache.start[number + 1] - cache.start[number]
        begin = np.cumsum(length) - length
        at = np.repeat(cache.start[number] - begin, length) + np.arange(length.sum())
        key = np.repeat(doc, length) * max(len(cache.pairs), 1) + cache.place[at]
        order = np.argsort(key, kind="stable")
        key, times = key[order], cache.times[at][order]
        cut = np.flatnonzero(np.diff(key, prepend=-1))
        self.times = np.add.reduceat(times, cut) if len(cut) else times
        self.doc, self.place = np.divmod(key[cut], max(len(cache.pairs), 1))

    def sha256(self) -> list[str]:
        return ["" if bad else hashlib.sha256(text.as_buffer()).hexdigest() for bad, text in zip(self.bad, self.joined)]


def aligned(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's figures, and its distinct linked pairs as ``a, b, times`` (how often each is linked).

    ``_row`` tells rows apart, whose keys may repeat or be null."""
    kind = docs.schema[key].dataType.simpleString()
    names = ["_row", "_key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = load(path_a, path_b)
        for batch in slices(batches, "_text"):
            one = Slice(batch.column("_text"), cache)
            offsets = pa.array(np.searchsorted(one.doc, np.arange(batch.num_rows + 1)).astype(np.int32))
            pair = cache.pairs[one.place]
            sides = (pair >> 32, pair & 0xFFFFFFFF, one.times)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in sides]
            columns = [*map(pa.array, one.figures), pa.array(one.sha256(), pa.string()), *lists]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_key"), *columns], names=names)

    figures = ", ".join(f"{c} long" for c in names[2:6])
    schema = f"_row long, _key {kind}, {figures}, groups_sha256 string, a array<int>, b array<int>, times array<int>"
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), docs[key].alias("_key"), docs[text].alias("_text"))
    return rows.mapInArrow(run, schema)


def _pairs(batch: pa.RecordBatch) -> np.ndarray:
    a, b = (np.asarray(batch.column(c).flatten(), dtype=np.int64) for c in "ab")
    return a << 32 | b


def pair_counts(found: DataFrame) -> DataFrame:
    """``pair, n, best``: documents that hold a pair linked, and whether no pair of its A id has more.

    A pair is the A id times 2**32 plus the B id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            own, times = np.unique(_pairs(batch), return_counts=True)
            pair, at = np.unique(np.concatenate((pair, own)), return_inverse=True)
            n = np.bincount(at, np.concatenate((n, times)), len(pair)).astype(np.int64)
            if len(pair) > GATHERED:
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])
                pair, n = pair[:0], n[:0]
        if len(pair):
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])

    counts = found.select("a", "b").mapInArrow(run, "pair long, n long")
    counts = written(counts.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    best = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))
    best = F.broadcast(best)  # a row an id of A
    return counts.join(best, F.shiftright("pair", 32) == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _level(n):
    return F.floor(F.log2(n) * 8).cast("int")


def hot_level(counts: DataFrame, most: int) -> int:
    """Least level of which all pairs from there on are no more than ``most``."""
    levels = counts.groupBy(_level(F.col("n")).alias("level")).count().orderBy(F.desc("level")).collect()
    total, least = 0, 1 << 30
    for r in levels:  # a level is an eighth of a doubling, so there are few
        total += r["count"]
        if total > most:
            break
        least = r["level"]
    return least


def align(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Per document: key, ``n_a, n_b, n_groups, n_links, n_best`` (links whose count is the highest of their A
    id), ``count_sum`` (counts of all links) and ``groups_sha256``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    found = written(aligned(docs, path_a, path_b, key, text), "aligned")
    counts = written(pair_counts(found), "counts")
    least = hot_level(counts, hot_pairs)
    hot = counts.where(_level(F.col("n")) >= least).toPandas().sort_values("pair")
    shared = spark.sparkContext.broadcast((hot["pair"].to_numpy(np.int64), hot["n"].to_numpy(np.int64), hot["best"].to_numpy(bool)))
    plain = [f for f in found.schema.fields if f.name not in ("a", "b", "times")]
    names = [*[f.name for f in plain], "n_best", "count_sum", "rare", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = shared.value
        for batch in batches:
            lists, pair = batch.column("times"), _pairs(batch)
            times = np.asarray(lists.flatten(), dtype=np.int64)
            offsets = np.concatenate(([0], np.cumsum(np.asarray(pc.list_value_length(lists), dtype=np.int64))))
            known = np.zeros(len(pair), bool)
            if len(pairs):
                at = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
                known = pairs[at] == pair
                n_best = sums(np.where(known & best[at], times, 0), offsets)
                total = sums(np.where(known, n[at], 0) * times, offsets)
            else:
                n_best = total = np.zeros(batch.num_rows, np.int64)
            rare = pa.array(np.concatenate(([0], np.cumsum(~known)))[offsets].astype(np.int32))
            left = [pa.ListArray.from_arrays(rare, pa.array(v[~known])) for v in (pair, times)]
            columns = [batch.column(f.name) for f in plain]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_best), pa.array(total), *left], names=names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain)
    found = found.mapInArrow(run, f"{kinds}, n_best long, count_sum long, rare array<long>, times array<long>")
    found = written(found, "known")
    rare = found.where(F.size("rare") > 0).select("_row", F.explode(F.arrays_zip("rare", "times")).alias("x"))
    rare = rare.select("_row", F.col("x.rare").alias("pair"), F.col("x.times").alias("times"))
    rare = rare.join(counts.where(_level(F.col("n")) < least), "pair")
    more = rare.groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum")
    )
    zero = F.lit(0).cast("long")
    return found.join(more, "_row", "left").select(
        F.col("_key").alias(key),
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        (F.col("n_best") + F.coalesce("_best", zero)).alias("n_best"),
        (F.col("count_sum") + F.coalesce("_sum", zero)).alias("count_sum"),
        "groups_sha256",
    )
