"""A bit table of fixed size over hashed keys: lets a scan pass by most rows that a later join would drop.

A key that is in the table's source always passes; others pass with the table's load as probability, which only
costs work, never rows.  The table has at most 2**25 bits (4 MB) whatever the source.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

MOST_BITS = 1 << 25


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sieve:
    def __init__(self, words: np.ndarray):
        self.words = words

    def passes(self, keys: np.ndarray) -> np.ndarray:
        bit = _mix(np.asarray(keys, dtype=np.int64).view(np.uint64)) & np.uint64(len(self.words) * 64 - 1)
        return (self.words[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) > 0


def build(keys: DataFrame, count: int) -> Sieve:
    """Of a column of longs; ``count`` sizes the table.  Ors of 64-bit words are what reaches the driver."""
    import pyarrow as pa

    name = keys.columns[0]
    bits = 1 << 12
    while bits < min(MOST_BITS, 16 * count):
        bits <<= 1

    def run(batches):
        for batch in batches:
            bit = _mix(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)) & np.uint64(bits - 1)
            flag = (np.uint64(1) << (bit & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((bit >> np.uint64(6)).astype(np.int64)), pa.array(flag)], ["word", "flag"])

    got = keys.where(F.col(name).isNotNull()).mapInArrow(tidy(run), "word long, flag long").groupBy("word").agg(F.bit_or("flag").alias("flag")).toPandas()
    words = np.zeros(bits // 64, dtype=np.uint64)
    words[got["word"].to_numpy(dtype=np.int64)] = got["flag"].to_numpy(dtype=np.int64).view(np.uint64)
    return Sieve(words)
