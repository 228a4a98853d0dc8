"""The packing plan, and documents packed by Spark."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lowtide.llm import packing
from lowtide.llm.token_ids import WordIds, encoded, load

PATH = public_tokenizers.path("word_bpe_49k.json")


def held(layouts, capacity):
    out = Counter()
    for x in layouts:
        assert x.count > 0 and 0 < sum(k * n for k, n in x.filling) <= capacity
        for k, n in x.filling:
            out[k] += n * x.count
    return dict(out)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 30), max_size=25))
def test_plan_holds_every_piece(counts):
    found = packing.plan(counts, 60)
    assert held(found.layouts, 60) == counts
    assert found.bound <= found.sequences <= sum(x.count for x in packing.best_fit(counts, 60))


def fewest(pieces, capacity):
    """By trying every way to put the pieces into sequences, longest first."""
    best = len(pieces)

    def put(at, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if at == len(pieces):
            best = len(rooms)
            return
        for i in {room: i for i, room in enumerate(rooms)}.values():
            if rooms[i] >= pieces[at]:
                put(at + 1, [*rooms[:i], rooms[i] - pieces[at], *rooms[i + 1 :]])
        put(at + 1, [*rooms, capacity - pieces[at]])

    pieces = sorted(pieces, reverse=True)
    put(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=10), st.integers(20, 30))
def test_small_cases_are_packed_best_and_proved(pieces, capacity):
    found = packing.plan(Counter(pieces), capacity)
    assert found.proved and found.sequences == fewest(pieces, capacity)


def test_a_spent_budget_is_no_proof(monkeypatch):
    r = random.Random(6)
    counts = Counter(r.randint(900, 2100) for _ in range(200))
    whole = packing.plan(counts, 4096)
    monkeypatch.setattr(packing, "STEPS", 3)
    spent = packing.plan(counts, 4096)
    assert held(spent.layouts, 4096) == counts
    assert not spent.proved and spent.sequences >= whole.sequences >= whole.bound >= spent.bound


def test_dominated_fillings():
    assert packing.dominated({5: 1, 3: 1}, [2], 2)  # 2 fits beside
    assert packing.dominated({5: 1, 3: 1}, [4], 1)  # 4 in place of 3
    assert packing.dominated({4: 1, 3: 1, 2: 1}, [5], 0)  # 5 in place of 3 and 2
    assert packing.dominated({3: 2}, [6], 0) and not packing.dominated({3: 1}, [6], 0)
    assert not packing.dominated({5: 1, 3: 1}, [2, 4], 0)


def test_completion_beats_best_fit():
    r = random.Random(4)
    over = Counter()
    for _ in range(20):  # sequences cut at random can be put together again
        counts, n = Counter(), r.randint(5, 25)
        for _ in range(n):
            left = 100
            for _ in range(r.randint(1, 3)):
                k = r.randint(10, 60)
                if k < left:
                    counts[k] += 1
                    left -= k
            counts[left] += 1
        over["plan"] += packing.plan(counts, 100).sequences - n
        over["best fit"] += sum(x.count for x in packing.best_fit(counts, 100)) - n
    assert over["plan"] == 0 < over["best fit"]


def test_ids_equal_the_tokenizer():
    r = random.Random(5)
    parts = ["a", "B", " ", "é", "É", "\n", "'s", "thing", "<|endoftext|>", "<", "|", ".", "!!", "…", "ß", "İ", "Σ", "́", "日", "🙂", "1", "23", "\xa0", "\x1c", "ﬁ", "K", "$$", "ſ", "ÿ."]
    texts = ["", None, "x" * 3000, "a" * 600 + " b"] + ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(2000)]
    ids, offsets = encoded(pa.array(texts), PATH)
    tokenizer = load(PATH)[0]
    for text, a, b in zip(texts, offsets, offsets[1:]):
        assert ids[a:b].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, text


def test_a_full_cache_is_begun_anew():
    tokenizer = load(PATH)[0]
    cache = WordIds(tokenizer, limit=10)
    for words in (["a", "b,", "thing"], ["other", "words", "é"], [f"w{i}" for i in range(12)]):
        numbers = cache.numbers(pa.array(words, pa.large_string()))
        got = [cache.flat[cache.start[n] : cache.start[n + 1]].tolist() for n in numbers]
        assert got == [tokenizer.encode(w, add_special_tokens=False).ids for w in words]


def test_documents_are_packed(spark):
    r = random.Random(9)
    text = lambda n: " ".join(r.choice(["a", "thing", "words!", "Zürich", "7"]) for _ in range(n))
    texts = [None, "", "a"] + [text(r.randint(1, 900)) for _ in range(60)] + [text(9000), " ".join(["a"] * 4096), " ".join(["a"] * 4095)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(5, texts[5], "clash"), (None, "a b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = packing.pack(docs, PATH).collect()
    tokenizer = load(PATH)[0]
    pieces = defaultdict(list)
    for i, t, _ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            pieces[i].append((k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    found = defaultdict(list)
    for x in got:
        found[x["doc_id"]].append((x["piece"], x["start"], x["length"], x["ids_crc32"]))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in pieces.items()}
    places = defaultdict(list)
    for x in got:
        places[x["sequence_id"]].append((x["offset"], x["length"]))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(places) == -(-sum(x["length"] for x in got) // 4096)


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_empty_tables_and_texts(spark, rows):
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    assert [(x["doc_id"], x["length"], x["offset"]) for x in got] == [(1, 1, 0)] * len(rows)
