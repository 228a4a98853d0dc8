"""Quality rules by repetition coverage.

Every text is cut into words ``[^\\x20\\x09-\\x0D]+``.  For several n-gram lengths a rolling hash
of the word numbers is taken at each place; places whose n-gram occurs twice or more in the text
are confirmed word by word, and the characters of all words inside such n-grams are measured, as
are the characters of lines that repeat an earlier line.  A text is kept if it is long enough and
if none of these shares exceeds its limit.

All work is per row: no shuffle, no state between rows, memory bounded by one slice of a batch.

Defined results: a null text has no words and fails; repeated rows are judged alike; an empty
table gives an empty result; other columns are passed through ``keep_good`` untouched and are
ignored by ``measure``, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lowtide.llm.storage import bounded_batches
from lowtide.llm.text import covered, mixed, owners, rolling, slices, split_words, strings, sums, window_starts

#: n-gram length of the base rule
BASE_N = 3
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rules:
    """Limits in percent of the characters in words."""

    min_words: int = 50
    repeat_words_pct: int = 50
    dup_line_chars_pct: int = 30
    ngram_chars_pct: dict[int, int] = field(default_factory=lambda: {5: 50, 10: 50})
    symbols_pct: int = 5


RULES = Rules()


def _repeats(codes: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """Starts of the n-grams that occur twice or more in their own text."""
    starts = window_starts(offsets, n)
    if len(starts) < 2:
        return starts[:0]
    text = owners(offsets)[starts]
    with np.errstate(over="ignore"):
        key = rolling(mixed(codes.astype(np.uint64)), n)[starts] + mixed(text.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    placed = starts[order]
    same = key[order][1:] == key[order][:-1]
    for j in range(n):  # equal hashes are confirmed on the words themselves
        same &= codes[placed[1:] + j] == codes[placed[:-1] + j]
    same &= text[order][1:] == text[order][:-1]
    twice = np.zeros(len(placed), bool)
    twice[1:] |= same
    twice[:-1] |= same
    return placed[twice]


def _lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines equal to an earlier line and having a word, and the characters in their words."""
    lists = pc.split_pattern(texts, "\n")
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    offsets -= offsets[0]
    lines = lists.flatten()
    code = np.asarray(lines.dictionary_encode().indices, dtype=np.int64)
    text = owners(offsets)
    order = np.lexsort((code, text))
    again = np.zeros(len(code), bool)
    again[order[1:]] = (code[order][1:] == code[order][:-1]) & (text[order][1:] == text[order][:-1])
    words = np.asarray(pc.binary_length(pc.ascii_trim_whitespace(lines))) > 0
    again &= words
    chars = np.zeros(len(code), np.int64)
    if again.any():
        repeated = lines.filter(pa.array(again))
        blank = np.asarray(pc.count_substring_regex(repeated, r"[\x20\x09-\x0D]"))
        chars[again] = np.asarray(pc.utf8_length(repeated)) - blank
    return sums(again, offsets), sums(chars, offsets)


def measured(texts: pa.Array, rules: Rules = RULES) -> dict[str, np.ndarray]:
    """The figures and both verdicts of every text of an Arrow array."""
    texts = strings(texts)
    words = split_words(texts)
    codes, _ = words.encoded()
    n_words = words.counts
    chars = np.asarray(pc.utf8_length(words.values), dtype=np.int64)
    out = {
        "n_words": n_words,
        "word_chars": sums(chars, words.offsets),
        "n_symbols": np.asarray(pc.count_substring_regex(texts, SYMBOLS), dtype=np.int64),
    }
    out["n_dup_lines"], out["dup_line_chars"] = _lines(texts)
    inside = covered(_repeats(codes, words.offsets, BASE_N), BASE_N, len(codes))
    out["n_repeat_words"] = sums(inside, words.offsets)
    out["base_failed"] = (n_words < rules.min_words) | (100 * out["n_repeat_words"] > rules.repeat_words_pct * n_words)
    total = out["word_chars"]
    good = ~out["base_failed"]
    good &= 100 * out["dup_line_chars"] <= rules.dup_line_chars_pct * total
    good &= 100 * out["n_symbols"] <= rules.symbols_pct * total
    for n, limit in rules.ngram_chars_pct.items():
        inside = covered(_repeats(codes, words.offsets, n), n, len(codes))
        out[f"dup_chars_{n}"] = sums(np.where(inside, chars, 0), words.offsets)
        good &= 100 * out[f"dup_chars_{n}"] <= limit * total
    out["kept"] = good
    return out


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Rules = RULES) -> DataFrame:
    """One row per document: the key, all figures, ``base_failed`` and ``kept``."""
    bounded_batches(docs.sparkSession)
    figures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    extra = ["dup_line_chars", *[f"dup_chars_{n}" for n in rules.ngram_chars_pct]]
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, " + ", ".join(f"{c} long" for c in figures) + ", base_failed boolean, kept boolean, "
    schema += ", ".join(f"{c} long" for c in extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            got = measured(batch.column("_text"), rules)
            columns = [batch.column("_key"), *[pa.array(got[c]) for c in (*figures, "base_failed", "kept", *extra)]]
            yield pa.RecordBatch.from_arrays(columns, names=[key, *figures, "base_failed", "kept", *extra])

    return docs.select(docs[key].alias("_key"), docs[text].alias("_text")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, text: str = "text", rules: Rules = RULES) -> DataFrame:
    """The rows whose text is kept, all columns unchanged."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            yield batch.filter(pa.array(measured(batch.column(text), rules)["kept"]))

    return docs.mapInArrow(run, docs.schema)
