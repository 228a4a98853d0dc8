"""Components of near-duplicates against all pairs of sets."""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict

import pytest

import corpus_pipeline
from lowtide.llm import minhash_dedup
from lowtide.llm.graph import components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) >= 5:
        return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return frozenset([tuple(words)]) if words else frozenset()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    common = " ".join(word() for _ in range(60))
    rows = [(0, None), (1, ""), (2, " \n"), (3, "Two words"), (4, "two  WORDS"), (5, "two words more"), (6, "É é"), (7, "é é")]
    n = len(rows)
    for _ in range(12):  # groups of near copies, chains of edits among them
        words = [word() for _ in range(r.randint(30, 120))]
        for _ in range(r.randint(1, 8)):
            rows.append((n, " ".join(words).upper() if r.random() < 0.2 else " ".join(words)))
            n += 1
            for _ in range(r.randint(0, 2)):
                words[r.randrange(len(words))] = word()
    base = [word() for _ in range(150)]
    for _ in range(60):  # a large group of near copies
        words = list(base)
        words[r.randrange(150)] = word()
        rows.append((n, " ".join(words)))
        n += 1
    for _ in range(60):  # a passage that many unlike documents share
        rows.append((n, common + " " + " ".join(word() for _ in range(60))))
        n += 1
    rows += [(n, rows[20][1]), (n + 1, " ".join(word() for _ in range(20_000)))]
    r.shuffle(rows)
    return rows


def test_same_components_as_all_pairs(spark, corpus):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in corpus], "doc_id long, text string, node string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(docs).collect()}
    assert got == brute(corpus)


def test_late_links_are_found_between_components(spark):
    """b meets neither a nor c through the first member of a list alone, yet all are linked."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(30):  # each differs from the one before in one word, so ends are far apart
        rows.append((i, " ".join(words)))
        words[(i * 7) % 200] = f"x{i}"
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in minhash_dedup.near_duplicates(docs).collect()}
    assert got == {i: v[1] for i, v in brute(rows).items()} and set(got.values()) == {0}


def test_rows_without_or_with_equal_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(None, a), (4, a), (4, a), (9, a), (None, b), (4, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(docs).collect())
    assert got == [(-1, 4, False), (-1, 4, False), (4, 4, True), (4, 4, True), (4, 4, True), (9, 4, False)]
    kept = minhash_dedup.keep_first(docs)
    assert kept.schema == docs.schema
    assert sorted(map(tuple, kept.collect())) == [(4, a), (4, a), (4, b)]


def test_empty_table(spark):
    assert minhash_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_a_graph(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(50)]
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = start
                todo += near[x]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if k != v}


def test_limit_is_a_parameter_and_the_pipeline_takes_eighty(spark):
    """Pairs of similarity 0.80 to 0.85 are near copies to the pipeline's stage and not to op4."""
    r = random.Random(9)
    rows, pairs = [], 40
    for i in range(pairs):  # 10 of 100 shingles replaced on each side: 90 / 110 = 0.818
        words = [f"{r.randrange(10**9)}" for _ in range(104)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:94] + [f"{r.randrange(10**9)}" for _ in range(10)]))]
    for a, b in zip(rows[::2], rows[1::2]):
        x, y = shingles(a[1]), shingles(b[1])
        assert 80 * len(x | y) <= 100 * len(x & y) < 85 * len(x | y)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert minhash_dedup.keep_first(docs).count() == 2 * pairs
    assert {x["doc_id"] for x in minhash_dedup.keep_first(docs, pct=80).collect()} == {2 * i for i in range(pairs)}
    assert {x["doc_id"] for x in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {2 * i for i in range(pairs)}


def test_agreement_follows_from_the_limit():
    assert minhash_dedup.agreement(85) == 42
    for pct in (60, 75, 80, 85, 90, 95):
        p, t = pct / 100, minhash_dedup.agreement(pct)
        below = [math.comb(64, i) * p**i * (1 - p) ** (64 - i) for i in range(t + 1)]
        assert sum(below[:-1]) <= minhash_dedup.MISSED < sum(below)


def test_rows_without_ids_are_linked_by_their_texts(spark):
    """Chains run through rows without an id, and one row of a component of only such rows is kept."""
    words = [f"w{i}" for i in range(200)]
    chain = []
    for i in range(8):  # ends are too far apart for a link of their own
        words[25 * i] = f"x{i}"
        words[25 * i + 10] = f"y{i}"
        chain.append(" ".join(words))
    alone = [" ".join(f"a{i}" for i in range(60)), " ".join([*(f"a{i}" for i in range(59)), "z"])]
    numbers = [5, None, None, None, None, None, None, 9]
    rows = [*zip(numbers, chain), (None, alone[0]), (None, alone[0]), (None, alone[1]), (None, alone[1].upper()), (None, ""), (None, None)]
    x, y = shingles(chain[0]), shingles(chain[-1])
    assert 100 * len(x & y) < 85 * len(x | y)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash_dedup.near_duplicates(docs).collect()
    of_chain = [r for r in got if r["n_shingles"] == 196]
    assert len(of_chain) == 8 and {r["component_id"] for r in of_chain} == {5}
    assert [r["doc_id"] for r in of_chain if r["kept"]] == [5]
    of_alone = [r for r in got if r["n_shingles"] == 56]
    assert len(of_alone) == 4 and {r["component_id"] for r in of_alone} == {None} and sum(r["kept"] for r in of_alone) == 1
    first = minhash_dedup.keep_first(docs)
    assert first.schema == docs.schema
    first = [tuple(r) for r in first.collect()]
    assert sum(t in chain for _, t in first) == 1 and (5, chain[0]) in first
    assert sum((t or "").lower() in alone for _, t in first) == 1
    assert len(first) == 4 and (None, None) in first and (None, "") in first
