"""A Bloom filter of bounded size, to leave out rows that can meet no partner before they are shuffled.

It decides nothing: what it lets through is joined exactly. Its bits are set by aggregation in the JVM and
reach the driver as at most ``MOST_BITS``, from where they are broadcast; beyond ``MOST_BITS /
BITS_A_KEY`` keys it lets more through, and still never holds a partner back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_A_KEY = 16
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28  # at most 32 MB
_BLOCK = 32_768  # bits that one aggregated bitmap holds


class Bloom:
    """The filter of a set of 64-bit hashes."""

    def __init__(self, hashes: DataFrame, n: int):
        """``hashes``: one column ``h``; ``n``: about how many."""
        bits = LEAST_BITS
        while bits < min(MOST_BITS, n * BITS_A_KEY):
            bits *= 2
        self.bits = bits
        places = F.array(F.col("h").bitwiseAND(bits - 1), F.shiftrightunsigned("h", 36).bitwiseAND(bits - 1))
        at = hashes.select(F.explode(places).alias("p"))
        blocks = at.groupBy((F.col("p") / _BLOCK).cast("long").alias("b")).agg(F.bitmap_construct_agg(F.col("p") % _BLOCK).alias("bits")).collect()
        data = np.zeros(bits // 8, np.uint8)
        for r in blocks:
            data[r["b"] * (_BLOCK // 8) : (r["b"] + 1) * (_BLOCK // 8)] = np.frombuffer(bytes(r["bits"]), np.uint8)
        self.data = hashes.sparkSession.sparkContext.broadcast(data.tobytes())

    def contains(self, h: np.ndarray) -> np.ndarray:
        """Whether each hash may be in the set; False is certain."""
        data = np.frombuffer(self.data.value, np.uint8)
        h = h.astype(np.int64, copy=False).view(np.uint64)
        out = np.ones(len(h), bool)
        for p in (h & np.uint64(self.bits - 1), (h >> np.uint64(36)) & np.uint64(self.bits - 1)):
            out &= (data[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out

    def might(self, h: Column) -> Column:
        """``contains`` as a column function."""

        @F.pandas_udf("boolean")
        def test(s: pd.Series) -> pd.Series:
            return pd.Series(self.contains(s.to_numpy(np.int64)))

        return test(h)
