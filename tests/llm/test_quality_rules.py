"""Repetition measures against plain Python, and the defined cases."""

from __future__ import annotations

import re

import pytest

from lowtide.llm.quality_rules import RULES, keep_good, measure

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    inside = {}
    for n in (3, *RULES.ngram_chars_pct):
        places = {}
        for i in range(len(words) - n + 1):
            places.setdefault(tuple(words[i : i + n]), []).append(i)
        inside[n] = {j for v in places.values() if len(v) > 1 for i in v for j in range(i, i + n)}
    seen, lines, line_chars = set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            if line in seen:
                lines += 1
                line_chars += sum(map(len, WORD.findall(line)))
            seen.add(line)
    chars = sum(map(len, words))
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    base = len(words) < 50 or 100 * len(inside[3]) > 50 * len(words)
    kept = not base and 100 * line_chars <= RULES.dup_line_chars_pct * chars and 100 * symbols <= RULES.symbols_pct * chars
    for n, limit in RULES.ngram_chars_pct.items():
        kept = kept and 100 * sum(len(words[i]) for i in inside[n]) <= limit * chars
    return (len(words), chars, symbols, lines, len(inside[3]), base, kept)


PLAIN = " ".join(f"w{i}é" for i in range(60))
TEXTS = [
    None,
    "",
    " \n\t ",
    PLAIN,
    PLAIN + "\n" + PLAIN,
    "a b c " * 40,
    "\n".join(["one line of it"] * 3 + [PLAIN]),
    PLAIN + " ### *** <b>",
    "ten words that are said twice over in this text " * 2 + PLAIN * 3,
    "\n".join([" ", " ", "x", "x ", "x"]) + PLAIN,
    "日本 語 " * 30 + PLAIN,
    " ".join(f"v{i % 7001}" for i in range(100_000)),
]


def test_same_figures_as_plain_python(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(3, PLAIN, "clash"), (None, PLAIN, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = measure(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        text = PLAIN if r["doc_id"] is None else TEXTS[r["doc_id"]]
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
        assert tuple(r[c] for c in names) == brute(text), text and text[:40]


def test_kept_rows_are_unchanged(spark):
    docs = spark.createDataFrame([(1, PLAIN, 5), (2, "short", 6), (3, None, 7), (1, PLAIN, 5)], "doc_id long, text string, kept int")
    kept = keep_good(docs)
    assert kept.schema == docs.schema
    assert sorted(map(tuple, kept.collect())) == [(1, PLAIN, 5), (1, PLAIN, 5)]


@pytest.mark.parametrize("run", [measure, keep_good])
def test_empty_table(spark, run):
    assert run(spark.createDataFrame([], "doc_id long, text string")).collect() == []
