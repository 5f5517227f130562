"""A set of 64-bit keys as a bitmap of fixed size, for filters before a shuffle.

A key outside the set may pass (the more, the fuller the bitmap), none inside is stopped. Its size
never grows with the data, so it may be broadcast; where it is full it only filters less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratiform.llm import common as C

BITS = 26
_PART = 16


def places(keys: np.ndarray) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)


def build(keys: DataFrame, key_col: str = "key") -> np.ndarray:
    """Bitmap of a column of longs: parts of 8 KiB are joined on the executors, 8 MiB come to the driver."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (BITS - 3), np.uint8)
        for batch in batches:
            at = places(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)))
        words = bits.view(np.int64).reshape(-1, 1 << (_PART - 6))
        used = np.flatnonzero(words.any(axis=1))
        for k in used:
            own = np.flatnonzero(words[k])
            yield pa.RecordBatch.from_arrays([pa.array(own + (k << (_PART - 6)), pa.int64()), pa.array(words[k][own], pa.int64())], ["at", "word"])

    words = C.map_arrow(C.pick(keys, key_col).filter(F.col(key_col).isNotNull()), local, [C.field("at", "long"), C.field("word", "long")]).groupBy("at").agg(F.bit_or("word").alias("word"))
    out = np.zeros(1 << (BITS - 6), np.int64)
    for row in words.toLocalIterator():
        out[row[0]] = row[1]
    return out.view(np.uint8)


def has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = places(keys)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def parted(df: DataFrame, bits: np.ndarray, key_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose key (a long) may be in the set, and those whose key surely isn't; nothing is shuffled."""
    sent, at = df.sparkSession.sparkContext.broadcast(bits), df.columns.index(key_col)

    def side(inside: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = has(sent.value, batch.column(at).to_numpy(zero_copy_only=False).view(np.uint64))
                yield batch.filter(pa.array(hit == inside))

        return C.map_arrow(df, run, df.schema.fields)

    return side(True), side(False)
