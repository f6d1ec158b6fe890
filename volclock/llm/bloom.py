"""A Bloom filter of 64-bit keys: built by Spark, asked in numpy inside tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each key, and the least and the most bits of all: at most 16 MB are broadcast, and
#: at most MOST / 64 rows of two numbers come to the driver.
PER_KEY, LEAST, MOST = 16, 1 << 16, 1 << 27


class Bloom:
    """Says of a key that it is absent, or may be there. A full filter lets everything pass, so
    that its bounded size decides on the work left, never on a result."""

    def __init__(self, bits: int, cells: np.ndarray):
        self.bits, self.cells = bits, cells

    @classmethod
    def of(cls, keys: DataFrame, most: int = MOST) -> Bloom:
        """Of one column of longs, each of them once. The column is evaluated twice."""
        keys = keys.toDF("key")
        n = keys.count()
        bits = min(most, max(LEAST, 1 << (PER_KEY * n).bit_length()))
        # the two positions are the same in Spark and numpy
        at = F.explode(F.array(F.col("key").bitwiseAND(bits - 1), F.shiftright("key", 32).bitwiseAND(bits - 1)))
        cells = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("word")).toArrow()
        out = np.zeros(bits // 64, np.int64)
        out[cells["cell"].to_numpy()] = cells["word"].to_numpy()
        return cls(bits, out)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for at in (keys & (self.bits - 1), (keys >> 32) & (self.bits - 1)):
            found &= (self.cells[at >> 6] >> (at & 63)) & 1 == 1
        return found
