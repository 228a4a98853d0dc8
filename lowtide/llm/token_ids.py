"""Token ids of whole Arrow batches for tokenizers whose tokens never reach across white space.

``IdCache`` keeps the ids of every word that a worker has met (bounded, then begun anew), so the
tokenizer itself sees each distinct word once.  This is exact for a lower-casing tokenizer that
drops white space and cuts words at every change between letters and punctuation:

* a word before lower-casing and after it has the same ids, so ASCII letters are folded first;
* punctuation after an ASCII or Latin-1 letter or a digit always begins a new token, so it is cut off;
* canonical composition never joins characters over a space.

Texts holding ``<|``, with which the special strings begin, are given to the tokenizer whole.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lowtide.llm.text import Words, split_words, strings

#: distinct words kept by a worker
CACHE_WORDS = 500_000
SEPARATOR = "<|endoftext|>"
WORD_END = "</w>"
WORDS_AT_ONCE = 256

_TOKENIZERS: dict[str, tuple] = {}


def load(path: str):
    """The tokenizer and its word cache, once per worker."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        _TOKENIZERS[path] = tokenizer, WordIds(tokenizer)
    return _TOKENIZERS[path]


class IdCache:
    """Token ids of the distinct words that a worker has met, in one array.

    ``new_ids`` gives the ids of words that are met for the first time."""

    def __init__(self, limit: int = CACHE_WORDS):
        self.limit = limit
        self._clear()

    def new_ids(self, words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The words in any order, all their ids, and where the ids of each end."""
        raise NotImplementedError

    def _clear(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)  # of word k; the end is the start of k + 1

    def _add(self, words: pa.Array) -> None:
        words, ids, ends = self.new_ids(words)
        have, used = len(self.known), int(self.start[len(self.known)])
        while used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while have + len(words) + 1 > len(self.start):
            self.start = np.concatenate((self.start, np.zeros_like(self.start)))
        self.flat[used : used + len(ids)] = ids
        self.start[have + 1 : have + len(words) + 1] = used + ends
        self.known = pa.concat_arrays([self.known, words])

    def numbers(self, vocabulary: pa.Array) -> np.ndarray:
        """Number of every word of a vocabulary, each distinct."""
        if len(self.known) + len(vocabulary) > self.limit:
            self._clear()
        found = pc.index_in(vocabulary, self.known)
        if found.null_count:
            self._add(vocabulary.filter(pc.is_null(found)))
            found = pc.index_in(vocabulary, self.known)
        return np.asarray(found, dtype=np.int64)

    def ids(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the offsets of the texts in them."""
        codes, vocabulary = words.encoded()
        number = self.numbers(vocabulary)[codes]
        first = self.start[number]
        length = self.start[number + 1] - first
        begin = np.concatenate(([0], np.cumsum(length)))
        place = np.repeat(first - begin[:-1], length) + np.arange(begin[-1])
        return self.flat[place], begin[words.offsets]


class WordIds(IdCache):
    def __init__(self, tokenizer, limit: int = CACHE_WORDS):
        super().__init__(limit)
        self.tokenizer = tokenizer
        self.separator = tokenizer.token_to_id(SEPARATOR)
        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a word
        self.last[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True

    def _encoded(self, texts: list[str]) -> np.ndarray:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(got), np.uint32, sum(map(len, got)))

    def new_ids(self, words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """New words are encoded many at a time.  A word of letters alone is one run, so its
        ids end with the one token that closes a word; between all others the special string is
        put, whose id then separates them."""
        letters = pc.match_substring_regex(words, "^[a-zà-öø-ÿ]+$")
        letters = pc.and_(letters, pc.invert(pc.match_substring_regex(words, "^.{500}")))
        plain, other = words.filter(letters), words.filter(pc.invert(letters))
        texts = plain.to_pylist()
        n = WORDS_AT_ONCE
        ids = self._encoded([" ".join(texts[i : i + n]) for i in range(0, len(texts), n)])
        ends = np.flatnonzero(self.last[ids]) + 1
        texts = other.to_pylist()
        # the string after each word, also the last of a text
        more = self._encoded([SEPARATOR.join((*texts[i : i + n], "")) for i in range(0, len(texts), n)])
        closed = more == self.separator
        more_ends = len(ids) + np.cumsum(~closed)[closed]
        ids, ends = np.concatenate((ids, more[~closed])), np.concatenate((ends, more_ends))
        assert len(ends) == len(words), "the tokenizer splits words of letters"
        return pa.concat_arrays([plain, other]), ids, ends


def cut_words(texts: pa.Array) -> Words:
    """Lower-cased words with the punctuation after letters and digits cut off."""
    folded = pc.ascii_lower(texts)
    folded = pc.replace_substring_regex(folded, r"([a-z0-9à-öø-ÿ])([.,!?*$%&#|;:]+)", r"\1 \2")
    return split_words(folded)


def encoded(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of every text (without added special tokens) in one array, and the offsets of the texts."""
    tokenizer, cache = load(path)
    texts = strings(texts)
    special = np.asarray(pc.match_substring(texts, "<|"))
    plain = pc.if_else(pa.array(special), pa.scalar("", texts.type), texts) if special.any() else texts
    ids, offsets = cache.ids(cut_words(plain))
    if special.any():
        parts = [ids[offsets[i] : offsets[i + 1]] for i in range(len(texts))]
        for i in np.flatnonzero(special):
            parts[i] = np.array(tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.uint32)
        ids = np.concatenate(parts)
        offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    return ids, offsets
