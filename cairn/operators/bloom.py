"""A Bloom filter of 64-bit keys, of fixed size: built by aggregation, tested in a scan's tasks before rows are made."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits: 512 KB, whatever the number of keys. Each key sets two bits: 200,000 keys let one in a hundred others pass.
WORDS = 1 << 16


def _places(keys: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(word, bit) of the two bits of each key."""
    h = keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return [((h >> np.uint64(shift)) & np.uint64(WORDS - 1), np.uint64(1) << (h >> np.uint64(bit) & np.uint64(63))) for shift, bit in ((48, 0), (32, 6))]


def table(keys: DataFrame, name: str) -> np.ndarray:
    """The filter of a column of longs; at most ``WORDS`` words reach the driver, combined in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, bits in _places(batch.column(0).to_numpy(zero_copy_only=False)):
                yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int32)), pa.array(bits.view(np.int64))], ["w", "b"])

    found = keys.select(F.col(name).cast("long")).where(F.col(name).isNotNull()).mapInArrow(run, "w int, b long").groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    out = np.zeros(WORDS, np.uint64)
    out[[r.w for r in found]] = np.array([r.b for r in found], np.int64).view(np.uint64)
    return out


def may_hold(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False only where no key is this one."""
    (a, x), (b, y) = _places(keys)
    return (words[a] & x != 0) & (words[b] & y != 0)
