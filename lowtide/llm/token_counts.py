"""Exact token counts of a sentence-piece model, huge documents by overlapping chunks.

A boundary between a character and a following space mark is *stable* if no piece of the
vocabulary holds a space mark after another character: merges then never reach across it, on
either side, so the tokens of both sides are found independently.  ``stable_marks`` proves this
from the vocabulary.  Two uses are made of it:

* ordinary texts are cut at stable boundaries and each distinct segment of a batch is encoded once;
* huge texts are encoded by the library in overlapping chunks with offsets.  Neighbours are spliced
  at a boundary that both encodings contain inside their overlap and that is stable.  If there is
  none (long runs without a space), the overlap is widened until there is one or the chunk reaches
  the end of the text.

Memory is bounded by one slice of texts and the segments of that slice; only a text without any
stable boundary has to be encoded whole, as the library would.

Defined results: a null text counts as empty, an empty text has 0 tokens; repeated rows are
counted alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from lowtide.llm.storage import bounded_batches
from lowtide.llm.text import slices, strings, sums

MARK = "▁"
#: texts of more characters than this are encoded in chunks
HUGE_CHARS = 50_000
CHUNK_CHARS = 32_768
OVERLAP_CHARS = 256

_MODELS: dict[str, tuple[sentencepiece.SentencePieceProcessor, bool]] = {}


def stable_marks(pieces: list[str]) -> bool:
    """Whether no piece holds a space mark after another character."""
    return not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)


def load(path: str) -> tuple[sentencepiece.SentencePieceProcessor, bool]:
    """The model, once per worker, and whether its boundaries before space marks are stable.

    Stability also needs a normaliser that leaves characters alone: it is probed on white space,
    compatibility characters and combining marks."""
    if path not in _MODELS:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        probe = " a  b\t 　ﬁ é Å​﻿z "
        plain = model.normalize(probe) == MARK + probe.replace(" ", MARK)
        _MODELS[path] = model, plain and stable_marks(pieces)
    return _MODELS[path]


def segments(text: str) -> list[str]:
    """The text cut at its stable boundaries: spaces (or marks) and what follows up to the next.

    Each segment lacks its first space, which the library puts before any text."""
    if not text:
        return []
    marked = " " + text.replace(MARK, " ")
    return [s[1:] for s in re.findall(r" +[^ ]*", marked)]


class Spliced:
    """Encoding of one huge text by overlapping chunks.

    Chunks start at stable boundaries only, so the library's own leading space mark stands for the
    space that the chunk starts with."""

    def __init__(self, model, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
        self.model, self.chunk, self.overlap = model, chunk, overlap
        self.widened = 0

    def _ends(self, text: str) -> np.ndarray:
        """End of every token of a chunk, in characters of the chunk."""
        places = self.model.encode(text, return_type="offset_mapping")["offsets"]
        return np.fromiter((end for _, end in places), np.int64, len(places))

    def count(self, text: str) -> int:
        """Tokens of a text whose spaces are plain spaces."""
        total, start, done = 0, 0, -1  # tokens that end at or before done are counted
        stop = min(len(text), self.chunk)
        ends = self._ends(text[start:stop])
        while stop < len(text):
            overlap = self.overlap
            while True:
                # the next chunk starts at the last stable boundary that leaves the overlap
                cut = self._boundary(text, start, stop - overlap)
                if cut is not None:
                    after = min(len(text), cut + 1 + self.chunk)
                    # the space at the cut is the mark that the library puts before a text
                    following = self._ends(text[cut + 1 : after]) + cut + 1
                    common = self._splice(text, ends + start, following, cut, stop)
                    if common is not None:
                        break
                self.widened += 1
                if cut is None:  # nothing to align with: make the present chunk longer
                    stop = min(len(text), stop + max(self.chunk, stop - start))
                    ends = self._ends(text[start:stop])
                    if stop == len(text):
                        break
                    overlap = self.overlap
                else:
                    overlap *= 2
            if cut is None:
                break
            total += int(np.count_nonzero((ends + start > done) & (ends + start <= common)))
            ends = following - (cut + 1)
            start, stop, done = cut + 1, after, max(done, common)
        return total + int(np.count_nonzero(ends + start > done))

    def _boundary(self, text: str, start: int, before: int) -> int | None:
        """Last place p in (start, before) with a space at p after another character."""
        p = text.rfind(" ", start + 1, max(before, start + 1))
        while p > start and text[p - 1] == " ":
            p -= 1
        return p if p > start + 1 and text[p - 1] != " " else None

    def _splice(self, text: str, left: np.ndarray, right: np.ndarray, cut: int, stop: int) -> int | None:
        """Last stable place after the cut at which a token ends in both encodings."""
        both = np.intersect1d(left, right)
        for p in both[::-1]:
            if cut < p < stop and text[p] == " " and text[p - 1] != " ":
                return int(p)
        return None


def counted(texts: pa.Array, path: str, huge: int = HUGE_CHARS) -> np.ndarray:
    """Number of tokens of every text of an Arrow array."""
    model, stable = load(path)
    texts = strings(texts)
    if not stable:
        return np.fromiter((len(x) for x in model.encode(texts.to_pylist(), num_threads=1)), np.int64, len(texts))
    long = np.asarray(pc.utf8_length(texts)) > huge
    # texts whose spaces are all single and inside need no regular expression
    odd = np.asarray(pc.match_substring_regex(texts, f"^ | $|  |{MARK}|^$")) & ~long
    out = np.zeros(len(texts), np.int64)
    lists = pc.split_pattern(texts.filter(pa.array(~long & ~odd)), " ")
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    parts = lists.flatten().dictionary_encode()
    own = np.fromiter((len(x) for x in model.encode(parts.dictionary.to_pylist(), num_threads=1)), np.int64, len(parts.dictionary))
    out[~long & ~odd] = sums(own[np.asarray(parts.indices)], offsets - offsets[0]) if len(offsets) > 1 else 0
    cache: dict[str, int] = {}
    for i in np.flatnonzero(odd):
        for s in segments(texts[i].as_py()):
            if s not in cache:
                # an empty segment is a single mark, which the library only gives inside a text
                cache[s] = len(model.encode(s, num_threads=1)) if s else len(model.encode("a ", num_threads=1)) - len(model.encode("a", num_threads=1))
            out[i] += cache[s]
    for i in np.flatnonzero(long):
        out[i] = Spliced(model).count(texts[i].as_py().replace(MARK, " "))
    return out


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """One row per document: key, UTF-8 bytes, tokens, and whether they exceed the limit."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "n_bytes", "n_tokens", "over_limit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            texts = strings(batch.column("_text"))
            n = counted(texts, path)
            size = pc.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("_key"), size, pa.array(n), pa.array(n > limit)], names=names)

    schema = f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean"
    return docs.select(docs[key].alias("_key"), docs[text].alias("_text")).mapInArrow(run, schema)
