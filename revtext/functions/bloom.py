"""Bloom filters of word tables, applied before an exchange.

A word outside the table stays where it is, but for a small share of false
positives that the join behind the filter drops.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revtext.functions.lookup import constant_array

#: Bits for each word, as long as the filter stays below ``MAX_BITS`` (4 MB in every task).
#: A larger table still gets a right answer, with more false positives.
BITS_PER_WORD = 12
MAX_BITS = 1 << 25

_LOW = 0xFFFFFFFF


class BloomFilter:
    """Bits of the words of a table; built by one aggregation of at most ``MAX_BITS / 64`` rows."""

    def __init__(self, table: DataFrame, word: str = "token"):
        words = table.select(F.col(word).alias("word")).where("word IS NOT NULL")
        count = max(words.count(), 1)
        self.bits = min(max(1 << math.ceil(math.log2(count * BITS_PER_WORD)), 64), MAX_BITS)
        self.hashes = min(max(round(self.bits / count * math.log(2)), 1), 8)
        at = words.select(F.explode(F.array(*self._positions(F.col("word")))).alias("at"))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
        cells = at.groupBy(F.shiftright("at", 6).alias("cell")).agg(F.bit_or(bit).alias("bits"))
        held = [0] * (self.bits // 64)
        for row in cells.collect():
            held[row.cell] = row.bits
        self._cells = constant_array(held, "bigint")

    def _positions(self, word: Column) -> list[Column]:
        digest = F.xxhash64(word)
        first = digest.bitwiseAND(F.lit(_LOW))
        # Odd, so that the steps reach every bit.
        step = F.shiftrightunsigned(digest, 32).bitwiseOR(F.lit(1).cast("long"))
        return [(first + step * k).bitwiseAND(F.lit(self.bits - 1).cast("long")) for k in range(self.hashes)]

    def may_hold(self, word: Column) -> Column:
        """False only for words outside the table."""
        found = F.lit(True)
        for at in self._positions(word):
            cell = F.get(self._cells, F.shiftright(at, 6).cast("int"))
            found = found & (F.call_function("getbit", cell, (at % 64).cast("int")) == 1)
        return found
