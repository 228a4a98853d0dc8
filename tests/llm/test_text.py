"""Words and rolling hashes against plain Python."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lowtide.llm.text import BASE, covered, rolling, slices, split_words, strings, window_starts

TEXT = st.text(alphabet="ab é\n\t\x0b\x0c\r\x1c 　日", max_size=30)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_words_are_the_runs_between_ascii_white_space(texts):
    words = split_words(strings(pa.array(texts, pa.string())))
    got = [words.values.to_pylist()[a:b] for a, b in zip(words.offsets, words.offsets[1:])]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


def test_words_of_a_slice_of_an_array():
    whole = pa.array(["a b", None, "ç d  e", "", "f"])
    assert split_words(strings(whole.slice(2, 2))).values.to_pylist() == ["ç", "d", "e"]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=40), st.integers(1, 21))
def test_rolling_hash_is_the_polynomial(codes, n):
    want = []
    for i in range(len(codes) - n + 1):
        total = 0
        for c in codes[i : i + n]:
            total = (total * int(BASE) + c) % 2**64
        want.append(total)
    assert rolling(np.array(codes, np.uint64), n).tolist() == want


def test_windows_stay_inside_their_text():
    offsets = np.array([0, 3, 3, 4, 9])
    assert window_starts(offsets, 3).tolist() == [0, 4, 5, 6]
    assert covered(np.array([0, 4]), 3, 9).tolist() == [True] * 3 + [False] + [True] * 3 + [False] * 2


def test_slices_keep_all_rows_and_split_large_ones():
    batch = pa.RecordBatch.from_pydict({"t": ["x" * 10, None, "", "y" * 100, "z"]})
    parts = list(slices(iter([batch, batch.slice(0, 0)]), "t", size=12))
    assert [p.num_rows for p in parts] == [3, 1, 1]
