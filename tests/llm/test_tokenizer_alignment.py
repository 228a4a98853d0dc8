"""Alignment of whole texts against the two libraries and plain Python."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from lowtide.llm import tokenizer_alignment as ta
from lowtide.llm.text import strings
from lowtide.llm.tokenizer_alignment import Tokenizers, align, segments

PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TOKENIZERS = Tokenizers(PATH_A, PATH_B)
SCHEMA = "doc_id long, text string, n_a string, pair int, rare int"
PARTS = ["a", "b", " ", "  ", "é", "\n", " \n", "thing", "ness", "ing ", "日本", "🙂", "\x00", "\t ", "!!", "\xa0", "  ", "'s", "x" * 30, "<|endoftext|>", "</s>", "123 "]


def brute(rows):
    """All of it from whole texts."""
    aligned, held = [], Counter()
    for i, text in rows:
        found = None
        if text:
            a = TOKENIZERS.a.encode(" " + text, add_special_tokens=False).ids
            b = TOKENIZERS.b.encode(text)
            x, y = (b"".join(raw[t] for t in ids) for ids, raw in ((a, TOKENIZERS.bytes_a), (b, TOKENIZERS.bytes_b)))
            if x == y == (" " + text).encode():
                cut, ends_a, ends_b = [], [], []
                for ids, raw, ends in ((a, TOKENIZERS.bytes_a, ends_a), (b, TOKENIZERS.bytes_b, ends_b)):
                    at = 0
                    for t in ids:
                        at += len(raw[t])
                        ends.append(at)
                low = 0
                for e in [e for e in ends_a if e in set(ends_b)]:
                    inside = [[t for t, z in zip(ids, ends) if low < z <= e] for ids, ends in ((a, ends_a), (b, ends_b))]
                    cut.append(tuple(inside))
                    low = e
                found = a, b, cut, [(p, q) for g, h in cut for p in g for q in h]
                held.update(set(found[3]))
        aligned.append((i, found))
    best = {}
    for (a, _), n in held.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for i, found in aligned:
        if found is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, cut, linked = found
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in cut)
        n_best = sum(held[p] == best[p[0]] for p in linked)
        out.append((i, len(a), len(b), len(cut), len(linked), n_best, sum(held[p] for p in linked), hashlib.sha256(text.encode()).hexdigest()))
    return out


def texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 25))) for _ in range(n)]


def rows_of():
    rows = list(enumerate(texts(300, 1)))
    rows += [(400, None), (401, ""), (402, " "), (403, "a ▁ b"), (404, "  lead and trail  "), (None, "no id here"), (None, None)]
    rows += [(405, "the same words"), (405, "the same words"), (406, "the same words")] + [(500 + i, "one common text, again") for i in range(40)]
    return rows + [(600, "x" * 20_000), (601, "many words " * 3000), (602, "日本語" * 500)]


@pytest.mark.parametrize("hot_pairs", [0, 40, 1 << 19])
def test_same_as_whole_texts(spark, hot_pairs):
    rows = rows_of()
    docs = spark.createDataFrame([(*x, "clash", 1, 2) for x in rows], SCHEMA).repartition(5)
    got = [tuple(r) for r in align(docs, PATH_A, PATH_B, hot_pairs=hot_pairs).collect()]
    order = lambda x: tuple(str(v) for v in x)
    assert sorted(got, key=order) == sorted(brute(rows), key=order)


def test_ranks_give_the_ids_of_the_library():
    assert TOKENIZERS.fast is not None
    for text in texts(500, 7):
        if text and max(text) < "\u0250":
            assert TOKENIZERS.fast.encode_ordinary(" " + text) == TOKENIZERS.a.encode(" " + text, add_special_tokens=False).ids


def test_tokens_end_at_every_cut():
    assert TOKENIZERS.cuts
    for text in texts(1500, 2):
        if not text:
            continue
        words = segments(strings(pa.array([text])), True)
        own = words.values.to_pylist()
        assert " ".join(own) == text
        a = [t for s in own for t in TOKENIZERS.a.encode(" " + s, add_special_tokens=False).ids]
        assert a == TOKENIZERS.a.encode(" " + text, add_special_tokens=False).ids
        assert [t for s in own for t in TOKENIZERS.b.encode(s)] == TOKENIZERS.b.encode(text)


def test_slices_end_where_both_end():
    ends_a, ends_b = np.array([1, 3, 4, 6]), np.array([3, 4, 5, 6])
    cut_a, cut_b = ta.common_ends(ends_a, ends_b)
    assert cut_a.tolist() == [2, 3, 4] and cut_b.tolist() == [1, 2, 4]


@pytest.mark.parametrize("written_out", [0, 3, 4096])
def test_links_of_large_groups(written_out, monkeypatch):
    monkeypatch.setattr(ta, "WRITTEN_OUT", written_out)
    a, b = np.array([5, 6, 5, 7]), np.array([1, 1, 2])
    group, pair, times = ta.links(a, b, np.array([3, 4]), np.array([2, 3]))
    got = Counter()
    for g, p, n in zip(group.tolist(), pair.tolist(), times.tolist()):
        got[g, p >> 32, p & 0xFFFFFFFF] += n
    assert got == {(0, 5, 1): 4, (0, 6, 1): 2, (1, 7, 2): 1}


def test_small_caches_and_batches(spark, monkeypatch):
    monkeypatch.setattr(ta, "CACHE_PAIRS", 50)
    cache = ta.Aligned(TOKENIZERS, limit=20)
    want = {i: x for i, *x in brute([(i, t) for i, t in enumerate(texts(60, 3))])}
    for i, t in enumerate(texts(60, 3)):
        monkeypatch.setattr(ta, "TOGETHER_CHARS", 1 + 7 * (i % 3))
        one = ta.Slice(pa.array([t]), cache)
        assert [int(v[0]) for v in one.figures] == want[i][:4] and one.sha256() == [want[i][6]]


def test_whole_texts_as_segments():
    words = segments(strings(pa.array(["a b", None, "c"])), False)
    assert words.values.to_pylist() == ["a b", "c"] and words.offsets.tolist() == [0, 1, 1, 2]


def test_empty(spark):
    assert align(spark.createDataFrame([], SCHEMA), PATH_A, PATH_B).collect() == []
    got = align(spark.createDataFrame([(1, None, "", 0, 0)], SCHEMA), PATH_A, PATH_B).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0, 0, 0, 0, "")]
