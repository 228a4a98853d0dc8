"""Words, their hashes and rolling hashes of whole Arrow batches, without a Python loop per word."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: characters of text handled at once inside a task; bounds the memory of a worker
SLICE_CHARS = 2_000_000
#: odd multiplier of the rolling hashes (arithmetic is modulo 2**64)
BASE = np.uint64(0x9E3779B97F4A7C15)


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array without nulls; a null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.offset:  # some string kernels misread an array that starts inside its buffers
        column = column.take(pa.array(np.arange(len(column))))
    return pc.fill_null(column.cast(pa.large_string()), "")


def release() -> None:
    """Give freed memory back to the system: workers are kept for later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], *text: str, size: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of about ``size`` bytes of these texts together, at least one row each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        length = sum(np.asarray(pc.fill_null(pc.binary_length(batch.column(t)), 0), dtype=np.int64) for t in text)
        ends = np.cumsum(length)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        release()


@dataclass
class Words:
    """Words of many texts: text ``i`` has the words ``offsets[i]`` to ``offsets[i + 1]``."""

    values: pa.Array
    offsets: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def encoded(self) -> tuple[np.ndarray, pa.Array]:
        """Number of each word in the vocabulary of these texts, and that vocabulary."""
        d = self.values.dictionary_encode()
        return np.asarray(d.indices, dtype=np.int64), d.dictionary


def split_words(texts: pa.Array) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+``: Arrow's ASCII white space is that class."""
    lists = pc.ascii_split_whitespace(texts)
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    values = lists.flatten()
    offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
    keep = np.asarray(pc.binary_length(values)) > 0  # ends of a text that are white space give ''
    if not keep.all():
        before = np.concatenate(([0], np.cumsum(keep)))
        offsets = before[offsets]
        values = values.filter(pa.array(keep))
    return Words(values, offsets)


def hashes(vocabulary: pa.Array) -> np.ndarray:
    """64-bit hash of every vocabulary entry; equal on every machine."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in vocabulary.to_pylist()), np.uint64, len(vocabulary))


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` codes that start at each place; the last n - 1 places are left out.

    A window of 2m codes is joined from two windows of m, so the cost is log n passes.
    """
    if len(codes) < n:
        return np.zeros(0, np.uint64)
    total, width, have = None, 0, codes.astype(np.uint64)
    power, length, rest = BASE, 1, n
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                if total is None:
                    total, width = have, length
                else:  # total covers the first places, have follows it
                    shift = np.uint64(pow(int(BASE), length, 1 << 64))
                    m = len(have) - width
                    total = total[:m] * shift + have[width:]
                    width += length
            rest >>= 1
            if rest:
                have = have[: len(have) - length] * power + have[length:]
                length *= 2
                power = np.uint64(pow(int(BASE), length, 1 << 64))
    return total[: len(codes) - n + 1]


def owners(offsets: np.ndarray) -> np.ndarray:
    """Number of the text that each place belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def window_starts(offsets: np.ndarray, n: int) -> np.ndarray:
    """Places at which a window of ``n`` starts and stays inside its text."""
    total = int(offsets[-1])
    if not total:
        return np.zeros(0, np.int64)
    ends = offsets[1:][owners(offsets)]
    places = np.arange(total)
    return places[places + n <= ends]


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Whether each of ``total`` places lies in a window of length ``n`` at one of the starts."""
    steps = np.bincount(starts, minlength=total + 1)[: total + 1] - np.bincount(starts + n, minlength=total + 1)[: total + 1]
    return np.cumsum(steps)[:total] > 0


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values of each text."""
    running = np.concatenate(([0], np.cumsum(values)))
    return running[offsets[1:]] - running[offsets[:-1]]
