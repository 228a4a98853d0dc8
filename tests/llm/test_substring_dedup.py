"""Repeated passages against a set of all earlier windows."""

from __future__ import annotations

import hashlib
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lowtide.llm import substring_dedup
from lowtide.llm.substring_dedup import SPAN, SuffixAutomaton
from lowtide.llm.text import split_words, strings


def brute(rows):
    """Kept words by document, for rows of distinct ids."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        words = split_words(strings(pa.array([text], pa.string()))).values.to_pylist()
        gone = [False] * len(words)
        for k in range(len(words) - SPAN + 1):
            window = tuple(words[k : k + SPAN])
            if window in seen:
                gone[k : k + SPAN] = [True] * SPAN
            seen.add(window)
        out[i] = (len(words), [w for w, g in zip(words, gone) if not g])
    return out


def corpus():
    r = random.Random(11)
    word = lambda: r.choice("the of and to in is".split()) if r.random() < 0.3 else "".join(r.choice("abcdé") for _ in range(4))
    passages = [[word() for _ in range(n)] for n in (19, 20, 21, 35, 60, 60, 200)]
    rows = [(0, None), (1, ""), (2, "x " * 100), (3, "a b " * 50), (4, " ".join(passages[1]))]
    for i in range(5, 90):
        words = []
        for _ in range(r.randint(0, 6)):
            words += r.choice(passages) if r.random() < 0.5 else [word() for _ in range(r.randint(1, 50))]
        rows.append((i, r.choice([" ", "\n", "  "]).join(words)))
    rows += [(i, " ".join([word(), *passages[4], word(), word()])) for i in range(90, 150)]
    rows += [(150, rows[20][1]), (151, rows[20][1]), (152, " ".join(word() for _ in range(30_000)) + " ".join(passages[6])), (None, rows[30][1])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [substring_dedup.HOT_COUNT, 2])
def test_same_words_as_all_windows(spark, hot, monkeypatch):
    rows = corpus()
    plain = substring_dedup.repeated_spans
    monkeypatch.setattr(substring_dedup, "repeated_spans", lambda unique, without: plain(unique, without, hot))
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, spans string").repartition(7)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.repeats(docs).collect()}
    want = {
        i: (n, n - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()) for i, (n, kept) in brute(rows).items()
    }
    assert got == want


def test_cut_texts(spark):
    rows = [(i, t) for i, t in corpus()]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars int")
    cut = substring_dedup.without_repeats(docs)
    assert cut.schema == docs.schema
    got = {r["doc_id"]: (r["text"] or "").split() for r in cut.collect()}
    want = {i: kept for i, (n, kept) in brute(rows).items() if kept or not n}
    assert got == {i: [w for w in kept] for i, kept in want.items()}
    assert all(r["n_chars"] == len(r["text"] or "") for r in cut.collect())


def test_rows_that_repeat_are_one_document(spark):
    words = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(7, words), (7, words), (8, words), (7, "z " + words)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.repeats(docs).collect())
    # of the two texts of id 7 the one of lower digest comes first
    assert got in ([(7, 40, 0), (7, 40, 0), (7, 41, 40), (8, 40, 40)], [(7, 40, 40), (7, 40, 40), (7, 41, 0), (8, 40, 40)])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    assert substring_dedup.repeats(docs).collect() == []
    assert substring_dedup.without_repeats(docs).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="abc", max_size=12), max_size=4), st.text(alphabet="abcd", max_size=14))
def test_matching_statistics(references, text):
    automaton = SuffixAutomaton()
    for x in references:
        automaton.add(list(x))
    want = []
    for end in range(1, len(text) + 1):
        want.append(max(n for n in range(end + 1) if n == 0 or any(text[end - n : end] in x for x in references)))
    assert automaton.matches(list(text)) == want
