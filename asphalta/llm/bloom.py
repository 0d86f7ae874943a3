"""Bloom filters of bounded size: they spare a join most of the rows that cannot match.

A filter never loses a key. Its size follows the number of keys up to a fixed most, so it
may be broadcast whatever the input; beyond that size ever more other keys pass, and the
exact join that follows has more to do. Nothing else depends on the size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Bits of the largest filter, which is 32 MB; good for about 20 million keys.
MOST_BITS = 28
#: Places of a key.
PLACES = 4


class Bloom:
    """A filter over the distinct values of a column of 64-bit hashes; null keys are no members."""

    def __init__(self, keys: DataFrame, key: str, most: int = MOST_BITS):
        spark = keys.sparkSession
        self.bits = bits = min(most, max(10, (12 * keys.count()).bit_length()))
        first, step = F.col(key).bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(key, 32)
        places = F.array(*[(first + step * i).bitwiseAND((1 << bits) - 1) for i in range(PLACES)])
        rows = (
            keys.where(F.col(key).isNotNull()).select(F.explode(places).alias("place"))
            .select(F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"))
            .groupBy("word").agg(F.bit_or("bit").alias("set")).toArrow())
        words = np.zeros(1 << (bits - 6), np.uint64)
        words[rows["word"].to_numpy()] = rows["set"].to_numpy().view(np.uint64)
        self.words = spark.sparkContext.broadcast(words)

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Which of these signed 64-bit keys may be members; all members are."""
        keys, words = np.ascontiguousarray(keys, np.int64).view(np.uint64), self.words.value
        first, step = keys & np.uint64(0xFFFFFFFF), keys >> np.uint64(32)
        found = np.ones(len(keys), bool)
        for i in range(PLACES):
            place = first + step * np.uint64(i) & np.uint64((1 << self.bits) - 1)
            found &= (words[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found

    def may_hold(self, key: Column | str) -> Column:
        """The same as a column; keys must not be null."""
        @F.pandas_udf("boolean")
        def holds(keys: pd.Series) -> pd.Series:
            return pd.Series(self.has(keys.to_numpy()))

        return holds(key)
