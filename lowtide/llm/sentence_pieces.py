"""Sentence-piece encoding by suffix-array matching, and decoding.

Text is cut at its stable boundaries (``token_counts``): no piece reaches over a space mark that
follows another character, so the distinct segments of a batch are encoded once each.  For the new
ones together:

1. the segments are concatenated and a suffix array of that text is built by prefix doubling, as
   deep as the longest piece is long;
2. every piece of the vocabulary is looked up by binary search, all pieces side by side, which
   gives its range of occurrences; a piece that ends a range of suffixes is an edge over the text;
3. the edges are sorted by the place where they end and relaxed from left to right, all segments
   side by side.

The model merges pairs by rank, so a segmentation is the model's own if and only if each piece is
what the model makes of its text, and no two neighbours would merge over their boundary when
encoded alone together.  For each place there is exactly one last piece that fits the last piece
at its start; relaxing finds it.  Which neighbours fit is worked out once for each pair of pieces
by running the merges on the two, and kept.  Characters without a piece become bytes.

The ids equal those of the library for the same model file (tests compare them).  Decoding joins
the bytes of the pieces; ``decode(encode(text))`` is the text, with space marks as spaces.

Defined results: a null text counts as empty and has no tokens; repeated rows are encoded alike;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from lowtide.llm.storage import bounded_batches
from lowtide.llm.text import Words, slices, strings
from lowtide.llm.token_counts import MARK, segments, stable_marks
from lowtide.llm.token_ids import IdCache

#: numbers from here on stand for single characters that are no piece
CHARS = 1 << 24
#: characters of new segments indexed at once
INDEX_CHARS = 2_000_000


class Vocabulary:
    """Normal pieces with their ranks, byte pieces, and which pieces may stand side by side."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        if not stable_marks([names[i] for i in normal]):
            raise ValueError("pieces of this model reach over space marks")
        # pieces merge in the order of their scores
        order = sorted(normal, key=lambda i: -model.get_score(i))
        self.rank = {names[i]: r for r, i in enumerate(order)}
        self.number = {names[i]: i for i in normal}
        self.names = names
        self.bytes = {int(names[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.pieces = [names[i] for i in normal if self._merged(names[i]) == [names[i]]]
        self.longest = max(map(len, self.pieces))
        self.pair = np.zeros(0, np.int64)
        self.fits = np.zeros(0, bool)
        # bytes of every piece, for decoding
        raw = [self._bytes(i, model) for i in range(n)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_start = np.concatenate(([0], np.cumsum([len(x) for x in raw])))

    def _bytes(self, i: int, model) -> bytes:
        if model.is_byte(i):
            return bytes([int(self.names[i][3:5], 16)])
        if model.is_control(i):
            return b""
        return " ⁇ ".encode() if model.is_unknown(i) else self.names[i].replace(MARK, " ").encode()

    def _merged(self, text: str) -> list[str]:
        """What merging by rank, leftmost first, makes of a short text."""
        parts = list(text)
        while len(parts) > 1:
            ranks = [self.rank.get(a + b) for a, b in zip(parts, parts[1:])]
            best = min((r for r in ranks if r is not None), default=None)
            if best is None:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def text(self, number: int) -> str:
        return chr(number - CHARS) if number >= CHARS else self.names[number]

    def side_by_side(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the pieces of each pair stay as they are when encoded together."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair, key), max(len(self.pair) - 1, 0))
        new = np.unique(key[self.pair[at] != key]) if len(self.pair) else np.unique(key)
        if len(new):
            found = []
            for k in new.tolist():
                a, b = self.text(k >> 32), self.text(k & 0xFFFFFFFF)
                found.append(self._merged(a + b) == [a, b])
            place = np.searchsorted(self.pair, new)
            self.pair = np.insert(self.pair, place, new)
            self.fits = np.insert(self.fits, place, found)
            at = np.searchsorted(self.pair, key)
        return self.fits[at]


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Places of the suffixes, sorted by their first ``depth`` characters at least."""
    order = np.argsort(codes, kind="stable")
    step = codes[order]
    rank = np.empty(len(codes), np.int64)
    rank[order] = np.concatenate(([0], np.cumsum(step[1:] != step[:-1])))
    length = 1
    while length < min(depth, len(codes)):  # after as many characters as there are, all suffixes differ
        after = np.zeros(len(codes), np.int64)
        after[: len(codes) - length] = rank[length:] + 1
        key = rank * (len(codes) + 1) + after
        order = np.argsort(key, kind="stable")
        step = key[order]
        rank[order] = np.concatenate(([0], np.cumsum(step[1:] != step[:-1])))
        length *= 2
    return order


def occurrences(codes: np.ndarray, array: np.ndarray, pieces: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Range of the suffix array that begins with each piece; ``pieces`` is padded with zeros."""
    low, high = np.zeros(len(pieces), np.int64), np.full(len(pieces), len(array))
    for j in range(int(length.max(initial=0))):
        active = np.flatnonzero((length > j) & (low < high))
        want = pieces[active, j]
        bounds = []
        for above in (False, True):  # first suffix with a character >= want, then > want
            a, b = low[active].copy(), high[active].copy()
            while (open_ := a < b).any():
                middle = (a + b) // 2
                place = np.minimum(array[np.minimum(middle, len(array) - 1)] + j, len(codes) - 1)
                less = (codes[place] <= want if above else codes[place] < want) & open_
                a = np.where(less, middle + 1, a)
                b = np.where(open_ & ~less, middle, b)
            bounds.append(a)
        low[active], high[active] = bounds
    return low, high


class PieceIds(IdCache):
    """Ids of distinct segments; a segment lacks its first space mark."""

    def __init__(self, path: str, **limits):
        super().__init__(**limits)
        self.vocabulary = Vocabulary(path)
        v = self.vocabulary
        self.length = np.array([len(p) for p in v.pieces])
        self.table = np.zeros((len(v.pieces), v.longest), np.int64)
        for i, p in enumerate(v.pieces):
            self.table[i, : len(p)] = [ord(c) for c in p]
        self.piece = np.array([v.number[p] for p in v.pieces])

    def new_ids(self, words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        ids, ends, used = [], [], 0
        size = np.cumsum(np.asarray(pc.utf8_length(words)) + 2)
        start = 0
        while start < len(words):
            stop = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + INDEX_CHARS)))
            own_ids, own_ends = self._encode(words[start:stop].to_pylist())
            ids.append(own_ids)
            ends.append(own_ends + used)
            used += len(own_ids)
            start = stop
        return words, np.concatenate(ids), np.concatenate(ends)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some segments, and where those of each end."""
        v = self.vocabulary
        whole = "\0".join(MARK + w.replace(" ", MARK) for w in words) + "\0"
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32).astype(np.int64) + 1
        size = np.array([len(w) + 1 for w in words])
        begin = np.cumsum(size + 1) - size - 1  # each segment is followed by one separator
        codes[begin + size] = 0  # below all characters, which are moved up by one
        # 1. index, 2. look up: edges (start, end, piece)
        array = suffix_array(codes, v.longest)
        low, high = occurrences(codes, array, np.where(self.table > 0, self.table + 1, 0), self.length)
        n = high - low
        which = np.repeat(np.arange(len(n)), n)
        start = array[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        end, piece = start + self.length[which], self.piece[which]
        # characters that are no piece of their own
        owner = np.repeat(np.arange(len(words)), size)
        place = np.arange(len(owner)) + owner  # all places but the separators
        single = np.zeros(len(codes) + 1, bool)
        single[start[end == start + 1]] = True
        bare = place[~single[place]]
        start = np.concatenate((start, bare))
        end = np.concatenate((end, bare + 1))
        piece = np.concatenate((piece, codes[bare] - 1 + CHARS))
        # 3. sort by the end inside the segment and relax
        word_of = np.zeros(len(codes) + 1, np.int64)
        word_of[place] = owner
        local = end - begin[word_of[start]]
        order = np.argsort(local, kind="stable")
        start, end, piece, local = start[order], end[order], piece[order], local[order]
        last = np.full(len(codes) + 1, -1)  # last piece of the encoding up to this place
        back = np.zeros(len(codes) + 1, np.int64)
        first = start == begin[word_of[start]]
        cuts = np.append(np.flatnonzero(np.diff(local, prepend=-1)), len(local))
        for a, b in zip(cuts, cuts[1:]):
            before = last[start[a:b]]
            good = first[a:b].copy()
            inner = np.flatnonzero(~good & (before >= 0))
            good[inner] = v.side_by_side(before[inner], piece[a:b][inner])
            last[end[a:b][good]] = piece[a:b][good]
            back[end[a:b][good]] = start[a:b][good]
        # from the ends back to the beginnings, all segments side by side
        at, word, pieces, owners_ = begin + size, np.arange(len(words)), [], []
        while len(at):
            pieces.append(last[at])
            owners_.append(word)
            at = back[at]
            left = at > begin[word]
            at, word = at[left], word[left]
        word, found = np.concatenate(owners_), np.concatenate(pieces)
        order = np.lexsort((-np.arange(len(word)), word))  # later steps come first in the text
        word, found = word[order], found[order]
        return self._with_bytes(word, found, len(words))

    def _with_bytes(self, word: np.ndarray, found: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece as bytes, or as the unknown piece if the model has no bytes."""
        v = self.vocabulary
        bare = np.flatnonzero(found >= CHARS)
        if len(bare):
            expanded = [
                [v.bytes[x] for x in chr(c - CHARS).encode()] if v.bytes else [v.unknown] for c in found[bare].tolist()
            ]
            times = np.ones(len(found), np.int64)
            times[bare] = [len(x) for x in expanded]
            place = np.cumsum(times) - times
            out = np.repeat(found, times)
            for p, x in zip(place[bare].tolist(), expanded):
                out[p : p + len(x)] = x
            word, found = np.repeat(word, times), out
        return found.astype(np.uint32), np.cumsum(np.bincount(word, minlength=n))


_CACHES: dict[str, PieceIds] = {}


def load(path: str) -> PieceIds:
    """The vocabulary and its cache, once per worker."""
    if path not in _CACHES:
        _CACHES[path] = PieceIds(path)
    return _CACHES[path]


def _segmented(texts: pa.Array) -> Words:
    """Segments of every text, each without its first space mark."""
    odd = np.asarray(pc.match_substring_regex(texts, f"^ | $|  |{MARK}|^$"))
    marked = pc.if_else(pa.array(odd), pa.scalar("", texts.type), texts) if odd.any() else texts
    lists = pc.split_pattern(marked, " ")
    if not odd.any():
        offsets = np.asarray(lists.offsets, dtype=np.int64)
        return Words(lists.flatten(), offsets - offsets[0])
    parts = lists.to_pylist()
    for i in np.flatnonzero(odd).tolist():
        parts[i] = segments(texts[i].as_py())
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    return Words(pa.array([x for p in parts for x in p], pa.large_string()), offsets)


def encode(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, and the offsets of the texts."""
    return load(path).ids(_segmented(strings(texts)))


def decode(ids: np.ndarray, offsets: np.ndarray, path: str) -> list[bytes]:
    """UTF-8 of the texts that the ids stand for."""
    v = load(path).vocabulary
    first = v.raw_start[ids]
    length = v.raw_start[ids.astype(np.int64) + 1] - first
    begin = np.concatenate(([0], np.cumsum(length)))
    body = v.raw[np.repeat(first - begin[:-1], length) + np.arange(begin[-1])].tobytes()
    cuts = begin[offsets].tolist()
    return [body[a + 1 : b] if body[a : a + 1] == b" " else body[a:b] for a, b in zip(cuts, cuts[1:])]


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and token ids of every document."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            ids, offsets = encode(batch.column("_text"), path)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("_key"), lists], names=[key, "ids"])

    return docs.select(docs[key].alias("_key"), docs[text].alias("_text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode_documents(rows: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Key and text of every row of token ids; null ids count as none."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [x or [] for x in batch.column("_ids").to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in values])))
            flat = np.array([i for x in values for i in x], np.uint32)
            texts = [t.decode("utf-8", "replace") for t in decode(flat, offsets, path)]
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(texts, pa.string())], names=[key, "text"])

    return rows.select(rows[key].alias("_key"), rows[ids].alias("_ids")).mapInArrow(run, f"`{key}` {kind}, text string")


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, n_tokens, ids_crc32 (little-endian unsigned 32-bit ids), decoded_crc32
    (UTF-8 of the decoded text) and whether decoding gave the text back."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "n_tokens", "ids_crc32", "decoded_crc32", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            texts = strings(batch.column("_text"))
            ids, offsets = encode(texts, path)
            data = memoryview(ids.astype("<u4").tobytes())
            cuts = (4 * offsets).tolist()
            crc = [zlib.crc32(data[a:b]) for a, b in zip(cuts, cuts[1:])]
            back = decode(ids, offsets, path)
            spaced = pc.replace_substring(texts, MARK, " ")
            same = [x == (y.as_buffer() or b"") for x, y in zip(back, spaced)]
            columns = [pa.array(np.diff(offsets)), pa.array(crc, pa.int64()), pa.array([zlib.crc32(x) for x in back], pa.int64()), pa.array(same)]
            yield pa.RecordBatch.from_arrays([batch.column("_key"), *columns], names=names)

    schema = f"`{key}` {kind}, n_tokens long, ids_crc32 long, decoded_crc32 long, round_trip boolean"
    return docs.select(docs[key].alias("_key"), docs[text].alias("_text")).mapInArrow(run, schema)
