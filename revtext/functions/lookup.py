"""Small constant tables probed inside one row.

A word array can be translated without exploding, joining and regrouping it
when the dictionary is small: entries are spread over the cells of an array of
tiny maps, and a word probes only the cell its CRC-32 names. The table is one
JSON literal that Catalyst folds into a constant, so a probe stays in the JVM
and the whole translation needs no shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from zlib import crc32

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

# Every task unpacks the constant, which takes about a second at this size; larger
# tables have to be joined.
MAX_ENTRIES = 100_000

# Bytes of the words of a constant table.
MAX_BYTES = 16 << 20

# JSON parsers bound the length of a field name; longer words are compared one
# by one.
MAX_JSON_KEY = 10_000


class Lookup:
    """Constant map from words to values; a missing word gives null."""

    def __init__(self, entries: Mapping[str, object], value_type: str):
        if len(entries) > MAX_ENTRIES:
            raise ValueError(f"{len(entries)} entries exceed the {MAX_ENTRIES} a lookup may hold")
        self.cells = 1 << max(4, len(entries).bit_length())
        cells: list[dict[str, object] | None] = [None] * self.cells
        self._long: dict[str, object] = {}
        for key, value in entries.items():
            if len(key) > MAX_JSON_KEY:
                self._long[key] = value
            else:
                at = crc32(key.encode()) % self.cells
                cells[at] = {**(cells[at] or {}), key: value}
        self._type = value_type
        text = json.dumps(cells, ensure_ascii=False, separators=(",", ":"))
        self._table = F.from_json(F.lit(text), f"array<map<string,{value_type}>>")

    def get(self, word: Column) -> Column:
        at = F.crc32(word.cast("binary")) % F.lit(self.cells)
        found = F.element_at(F.get(self._table, at.cast("int")), word)
        if self._long:
            keys, values = F.array(*map(F.lit, self._long)), F.array(*map(F.lit, self._long.values()))
            long = F.map_from_arrays(keys, values.cast(f"array<{self._type}>"))
            found = F.when(F.length(word) > MAX_JSON_KEY, F.element_at(long, word)).otherwise(found)
        return found


def small_table(table: DataFrame) -> list[Row] | None:
    """The rows of a table of words (first column), or None if it is too large for a constant."""
    size = F.sum(F.octet_length(table.columns[0]).cast("long"))
    total = table.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(size, F.lit(0)).alias("bytes")).first()
    return table.collect() if total.rows <= MAX_ENTRIES and total.bytes <= MAX_BYTES else None


def constant_array(values: Sequence[float], element_type: str = "double") -> Column:
    """A numeric array constant, addressed by position with ``F.get``."""
    return F.from_json(F.lit(json.dumps(list(values))), f"array<{element_type}>")
