"""Packing of tokenized documents into windows by best-fit decreasing.

A document is cut into full windows and one rest. Pieces go to shards by a
hash of id, place and tokens, so a repeated task deals them alike; a shard is packed in one
task, of about ``SHARD_BYTES`` of text whatever the corpus holds. Shards only share
the window size, so the last windows of each are all that sharding can cost.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revtext.llm.batches import joined, map_batches
from revtext.llm.tokens import ENCODED_BYTES, ENCODED_ROWS, encoder, tokenizer_path

WINDOW = 2048
END_ID = 1
SHARD_BYTES = 32 << 20
#: Sequences of one output batch.
OUT_ROWS = 256


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree over the capacities."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.full = [False] * (2 * self.leaves)  # does a node's range hold an open window?
        self.stacks: list[list[int]] = [[] for _ in range(size + 1)]

    def _mark(self, capacity: int, there: bool) -> None:
        node, tree = capacity + self.leaves, self.full
        tree[node] = there
        node >>= 1
        while node:
            now = tree[2 * node] or tree[2 * node + 1]
            if tree[node] == now:
                break
            tree[node] = now
            node >>= 1

    def add(self, window: int, capacity: int) -> None:
        self.stacks[capacity].append(window)
        if len(self.stacks[capacity]) == 1:
            self._mark(capacity, True)

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least capacity of at least ``need``, and that capacity."""
        node, tree = need + self.leaves, self.full
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if tree[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        window = self.stacks[capacity].pop()
        if not self.stacks[capacity]:
            self._mark(capacity, False)
        return window, capacity


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece; ties keep their order. Every length is 1 to ``window``."""
    placed, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    windows, count = OpenWindows(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = windows.take(need)
        if found is None:
            found, count = (count, window), count + 1
        at, capacity = found
        placed[i], offsets[i] = at, window - capacity
        if capacity > need:
            windows.add(at, capacity - need)
    return placed, offsets


def pieces(docs: DataFrame, window: int = WINDOW, path: str | None = None) -> DataFrame:
    """``doc_id, start, length, doc_tokens, ids``: each document's ids and the end id, cut.

    A null text counts as empty and has the end id alone. ``ids`` are
    little-endian, two bytes each for vocabularies up to 65,536.
    """
    path = path or tokenizer_path()
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.array([END_ID], enc.dtype)
        for batch in joined(batches, ENCODED_BYTES):
            keys, starts, lengths, totals, raw = [], [], [], [], []
            encoded = enc.encode(batch.column(1))
            for key, ids in zip(batch.column(0).to_pylist(), encoded, strict=True):
                ids = np.concatenate([ids, end])
                for at in range(0, len(ids), window):
                    part = ids[at : at + window]
                    keys.append(key)
                    starts.append(at)
                    lengths.append(len(part))
                    totals.append(len(ids))
                    raw.append(part.tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, batch.schema.field(0).type),
                    pa.array(starts, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(totals, pa.int64()),
                    pa.array(raw, pa.binary()),
                ],
                ["doc_id", "start", "length", "doc_tokens", "ids"],
            )

    return map_batches(
        docs.select("doc_id", "text"),
        work,
        f"doc_id {id_type}, start long, length long, doc_tokens long, ids binary",
        ENCODED_ROWS,
    )


def pack(docs: DataFrame, window: int = WINDOW, path: str | None = None) -> DataFrame:
    """Sequences ``sequence_id, n_tokens, ids, pieces`` of all rows of ``docs``.

    ``pieces`` are (doc_id, start, length, ids_crc32, doc_tokens, offset) by
    offset; they fill a sequence from 0 without gaps. Pad ``ids`` to ``window``
    when reading. Null ids stay null, repeated rows are packed as often as
    they occur, an empty table gives no sequence, other columns are not read.
    """
    path = path or tokenizer_path()
    id_type = docs.schema["doc_id"].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    shards = max(1, math.ceil(((size.b or 0) + size.n) / SHARD_BYTES))
    slot = F.xxhash64("doc_id", "start", "ids").alias("slot")
    cut = pieces(docs, window, path).select(slot, "*").repartition(shards, "slot")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [*batches]
        if not found:
            return
        rows = pa.Table.from_batches(found)
        dtype, first = encoder(path).dtype, TaskContext.get().partitionId() << 32
        rows = rows.sort_by([("slot", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
        keys, raw = rows["doc_id"].to_pylist(), rows["ids"].combine_chunks()
        starts, totals = rows["start"].to_numpy(), rows["doc_tokens"].to_numpy()
        lengths = rows["length"].to_numpy()
        placed, offsets = best_fit_decreasing(lengths, window)
        order = np.lexsort((offsets, placed))
        edges = np.flatnonzero(np.diff(placed[order], prepend=-1, append=-1))
        names = ["sequence_id", "n_tokens", "ids", "pieces"]
        for at in range(0, len(edges) - 1, OUT_ROWS):
            out = [[], [], [], []]
            for a, b in zip(edges[at : at + OUT_ROWS], edges[at + 1 : at + OUT_ROWS + 1], strict=False):
                parts, joined = [], []
                for i in order[a:b].tolist():
                    ids = raw[i].as_py()
                    wide = np.frombuffer(ids, dtype).astype("<u4")
                    joined.append(ids)
                    parts.append(
                        {
                            "doc_id": keys[i],
                            "start": int(starts[i]),
                            "length": int(lengths[i]),
                            "ids_crc32": zlib.crc32(wide.tobytes()),
                            "doc_tokens": int(totals[i]),
                            "offset": int(offsets[i]),
                        }
                    )
                out[0].append(first + int(placed[order[a]]))
                out[1].append(int(lengths[order[a:b]].sum()))
                out[2].append(b"".join(joined))
                out[3].append(parts)
            long = pa.int64()
            kind = pa.struct(
                [
                    ("doc_id", rows.schema.field("doc_id").type),
                    *((n, long) for n in ("start", "length", "ids_crc32", "doc_tokens", "offset")),
                ]
            )
            types = [long, long, pa.binary(), pa.list_(kind)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out, types, strict=True)], names
            )

    piece = (
        f"struct<doc_id:{id_type},start:bigint,length:bigint,ids_crc32:bigint,"
        "doc_tokens:bigint,offset:bigint>"
    )
    return map_batches(
        cut, work, f"sequence_id long, n_tokens long, ids binary, pieces array<{piece}>"
    )


def placements(sequences: DataFrame, ids: bool = False) -> DataFrame:
    """One row per piece of packed ``sequences``, with its own ``ids`` if wanted."""
    rows = sequences.select("sequence_id", "n_tokens", "ids", F.explode("pieces").alias("p"))
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    found = [*(F.col(f"p.{n}") for n in names), F.col("sequence_id"), F.col("p.offset")]
    if ids:
        width = (F.octet_length("ids") / F.col("n_tokens")).cast("int")
        first, size = (F.col("p.offset") * width + 1).cast("int"), (F.col("p.length") * width).cast("int")
        found.append(F.substr("ids", first, size).alias("ids"))
    return rows.select(*found)
