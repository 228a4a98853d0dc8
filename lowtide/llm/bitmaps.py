"""Bitmaps of hashed keys, of a fixed size, that keep most rows out of a shuffle.

A bitmap tells that a key is surely not wanted or that it may be.  Its size is set by the number
of bits alone, so it can be broadcast at every size of the input; the join after it decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 24
PARTS = 16


def slot(hash_: Column, bits: int = BITS) -> Column:
    """Slot of a 64-bit hash."""
    return F.shiftrightunsigned(hash_, 64 - bits).cast("long")


def bitmap(rows: DataFrame, hash_: Column, bits: int = BITS) -> np.ndarray:
    """Bitmap of 2**bits slots with the slots of these hashes set; built in parts by tasks."""
    size = (1 << bits) // PARTS
    slots = rows.select(slot(hash_, bits).alias("slot")).distinct()
    slots = slots.withColumn("part", F.floor(F.col("slot") / size).cast("int"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            part, at = np.asarray(batch.column("part")), np.asarray(batch.column("slot"))
            for p in np.unique(part).tolist():
                found.setdefault(p, np.zeros(size, bool))[at[part == p] - p * size] = True
        for p, b in found.items():
            columns = [pa.array([p], pa.int32()), pa.array([np.packbits(b).tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "bits"])

    out = np.zeros((PARTS, size // 8), np.uint8)
    for r in slots.repartition("part").select("part", "slot").mapInArrow(merge, "part int, bits binary").collect():
        out[r["part"]] |= np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def held(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Whether the slots are set."""
    return (bits[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1 > 0


def kept(rows: DataFrame, hash_: Column, bits: np.ndarray, inside: bool = True) -> DataFrame:
    """The rows whose hash may be in the bitmap, or with ``inside=False`` surely is not."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)
    width = int(np.log2(len(bits) * 8))
    name = "_slot"
    while name in rows.columns:
        name += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = held(shared.value, np.asarray(batch.column(name), dtype=np.int64))
            yield batch.filter(pa.array(mask if inside else ~mask)).select(batch.schema.names[:-1])

    return rows.withColumn(name, slot(hash_, width)).mapInArrow(run, rows.schema)
