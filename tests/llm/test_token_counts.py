"""Token counts and sentence pieces against the library."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from lowtide.llm import sentence_pieces, token_counts
from lowtide.llm.token_counts import MARK, Spliced, counted, segments, stable_marks

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = sentencepiece.SentencePieceProcessor(model_file=PATH)
PARTS = ["a", "b", " ", "  ", "é", "\n", "thing", "ness", MARK, "ing ", "日", "🙂", "\x00", "\t", "!!", "\xa0", "", "x" * 20]


def texts(n, most, seed):
    r = random.Random(seed)
    return [None, "", " ", "  ", "a ", " a", MARK, "<s> </s>"] + ["".join(r.choice(PARTS) for _ in range(r.randint(0, most))) for _ in range(n)]


def test_stable_boundaries():
    assert stable_marks([MARK + "a", MARK * 3, "b"])
    assert not stable_marks(["a" + MARK])
    assert segments(" a  b ") == [" a", " b", ""] or segments(" a  b ")[-1] == ""


def test_counts_of_ordinary_texts():
    some = texts(800, 40, 1)
    assert counted(pa.array(some), PATH).tolist() == [len(MODEL.encode(t or "")) for t in some]


def test_counts_of_huge_texts():
    some = texts(60, 400, 2)
    assert counted(pa.array(some), PATH, huge=50).tolist() == [len(MODEL.encode(t or "")) for t in some]


def test_chunks_are_spliced_and_overlaps_widened():
    r, widened = random.Random(3), 0
    for k, t in enumerate(texts(400, 300, 3)):
        t = (t or "").replace(MARK, " ")
        if k % 9 == 0:
            t = t.replace(" ", "") + " " + t
        spliced = Spliced(MODEL, chunk=r.choice([20, 40, 90]), overlap=r.choice([2, 5, 20]))
        assert spliced.count(t) == len(MODEL.encode(t))
        widened += spliced.widened
    assert widened


def test_token_count_table(spark):
    long = "words and more " * 9000 + "x" * 70_000
    rows = [(1, "two words", "clash"), (1, "two words", "clash"), (2, None, "clash"), (None, long, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(docs, PATH).collect())
    n = len(MODEL.encode(long))
    assert got == [(0, len(long), n, True), (1, 9, 2, False), (1, 9, 2, False), (2, 0, 0, False)]


@pytest.mark.parametrize("run", [token_counts.token_counts, sentence_pieces.digests, sentence_pieces.encode_documents])
def test_empty_table(spark, run):
    assert run(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_pieces_equal_the_library_and_decode_gives_the_text():
    some = texts(800, 40, 4) + ["ab" * 3000]
    ids, offsets = sentence_pieces.encode(pa.array(some), PATH)
    back = sentence_pieces.decode(ids, offsets, PATH)
    for text, a, b, again in zip(some, offsets, offsets[1:], back):
        assert ids[a:b].tolist() == MODEL.encode(text or ""), text
        assert again.decode() == (text or "").replace(MARK, " ")


def test_encode_and_decode_tables(spark):
    rows = [(i, t, "clash") for i, t in enumerate(texts(40, 30, 6))] + [(None, "again", None), (3, "  ", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    coded = sentence_pieces.encode_documents(docs, PATH)
    assert sorted(map(str, coded.collect())) == sorted(map(str, [(i, MODEL.encode(t or "")) for i, t, _ in rows])) or all(
        r["ids"] == MODEL.encode(dict((i, t) for i, t, _ in rows)[r["doc_id"]] or "") for r in coded.collect()
    )
    again = sentence_pieces.decode_documents(coded, PATH)
    assert sorted((str(r["doc_id"]), r["text"]) for r in again.collect()) == sorted((str(i), (t or "").replace(MARK, " ")) for i, t, _ in rows)
    assert all(r["round_trip"] for r in sentence_pieces.digests(docs, PATH).collect())


def test_suffix_array_ranges():
    import numpy as np

    text = "banana\0bandana\0"
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    array = sentence_pieces.suffix_array(codes, 4)
    assert [text[i : i + 4] for i in array] == sorted(text[i : i + 4] for i in range(len(text)))
    pieces = ["ana", "b", "ban", "x", "nan", "dana"]
    table = np.zeros((len(pieces), 4), np.int64)
    for k, p in enumerate(pieces):
        table[k, : len(p)] = [ord(c) for c in p]
    low, high = sentence_pieces.occurrences(codes, array, table, np.array([len(p) for p in pieces]))
    got = [sorted(array[a:b].tolist()) for a, b in zip(low, high)]
    assert got == [[i for i in range(len(text)) if text.startswith(p, i)] for p in pieces]


@pytest.mark.parametrize("length", range(1, 41))
def test_suffix_arrays_of_every_length(length):
    r = random.Random(length)
    for depth in range(1, 18):
        codes = np.array([r.choice((1, 2, 3)) for _ in range(length)])
        array = sentence_pieces.suffix_array(codes, depth)
        assert sorted(array.tolist()) == list(range(length))
        heads = [codes[i : i + depth].tolist() for i in array]
        assert heads == sorted(heads)


def test_one_new_word_in_a_warm_cache():
    cache = sentence_pieces.PieceIds(PATH)
    some = ["a", "word", "b c", "xyz", "12345", "", "é"]
    for t in some:
        for again in (t, t + t):
            ids, _ = cache.ids(sentence_pieces._segmented(token_counts.strings(pa.array([again]))))
            assert ids.tolist() == MODEL.encode(again)
