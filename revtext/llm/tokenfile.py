"""Token ids on disk: frequency ranks in bytes of variable number, control bytes apart.

Ids are replaced by their frequency rank (ties by id), so frequent ones take
one byte. A value takes 1 to 4 bytes, little end first; two bits a value give
that number less one, four values to a control byte, first value in the low
bits. A block is a row of a Parquet file and holds whole documents:

``part, block``  place of the block: parts ascend, and blocks within a part
``first``  ids of the part before the block
``doc_ids, lengths``  of its documents, in order
``control, data``  the bytes of all ids of its documents

``ranks`` beside the blocks has the id of every rank. Blocks stay under
``BLOCK_IDS`` ids, or hold one longer document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revtext.llm.batches import joined, map_batches
from revtext.llm.tokens import ENCODED_BYTES, ENCODED_ROWS, encoder, tokenizer_path
from revtext.storage import stage

END_ID = 2
BLOCK_IDS = 1 << 18

#: Bytes of each of the four values of a control byte.
WIDTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1).astype(np.uint8)


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit ``values``."""
    values = values.astype("<u4")
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    widest = int(values.max(initial=0))
    bounds = [x for x in (0xFF, 0xFFFF, 0xFFFFFF) if widest > x]
    kept = np.ones((len(values), 1 + len(bounds)), bool)
    for k, bound in enumerate(bounds, start=1):
        np.greater(values, bound, out=kept[:, k])
        codes[: len(values)] += kept[:, k]
    octets = values.view(np.uint8).reshape(-1, 4)[:, : 1 + len(bounds)]
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    return control.tobytes(), octets[kept].tobytes()


def decode_values(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The ``count`` values behind control and data bytes."""
    widths = WIDTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    ends = np.cumsum(widths, dtype=np.int64)
    begin = ends - widths
    if count and ends[-1] != len(data):
        raise ValueError("the data bytes do not fit the control bytes")
    octets = np.frombuffer(data + b"\0\0\0", np.uint8)
    values = octets[begin].astype(np.uint32)
    for k in range(1, int(widths.max(initial=1))):
        wide = np.flatnonzero(widths > k)
        values[wide] |= octets[begin[wide] + k].astype(np.uint32) << np.uint32(8 * k)
    return values


def encode_documents(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """``doc_id, ids`` (little-endian binary) of every row, the end id last."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in joined(batches, ENCODED_BYTES):
            ids = [x.tobytes() + end for x in enc.encode(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"]
            )

    return map_batches(docs.select("doc_id", "text"), work, f"doc_id {id_type}, ids binary", ENCODED_ROWS)


def frequency_ranks(encoded: DataFrame, path: str) -> np.ndarray:
    """Ids by falling frequency over all documents, ties by id; as many as the vocabulary has."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        counts = np.zeros(enc.size, np.int64)
        for batch in batches:
            joined = np.frombuffer(b"".join(batch.column(0).to_pylist()), enc.dtype)
            counts += np.bincount(joined, minlength=len(counts))
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["id", "n"])

    counts = map_batches(encoded.select("ids"), work, "id long, n long")
    rows = counts.groupBy("id").agg(F.sum("n").alias("n")).collect()  # one per vocabulary entry at most
    totals = np.zeros(encoder(path).size, np.int64)
    for row in rows:
        totals[row.id] = row.n
    return np.argsort(-totals, kind="stable")


def write_token_files(
    docs: DataFrame, out: str, path: str | None = None, end_id: int = END_ID
) -> None:
    """Write all rows of ``docs`` under ``out`` in ascending ``doc_id`` order, nulls first.

    Rows of one ``doc_id`` are ordered by their ids. A null text counts as
    empty. Other columns are not read.
    """
    path = path or tokenizer_path()
    spark = docs.sparkSession
    encoded = stage(encode_documents(docs, path, end_id), "ids", codec="zstd")
    by_rank = frequency_ranks(encoded, path)
    rank_of = np.empty(len(by_rank), np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    table = spark.sparkContext.broadcast(rank_of)  # one entry per vocabulary entry
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype, part, block = encoder(path).dtype, TaskContext.get().partitionId(), 0
        keys, rows, size, first = [], [], 0, 0

        def close(kind: pa.DataType) -> pa.RecordBatch:
            joined = np.concatenate(rows)
            control, data = encode_values(table.value[joined])
            names = ["part", "block", "first", "doc_ids", "lengths", "control", "data"]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int64()),
                    pa.array([block], pa.int64()),
                    pa.array([first], pa.int64()),
                    pa.array([keys], pa.list_(kind)),
                    pa.array([[len(r) for r in rows]], pa.list_(pa.int64())),
                    pa.array([control], pa.binary()),
                    pa.array([data], pa.binary()),
                ],
                names,
            )

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(raw, dtype)
                if rows and size + len(ids) > BLOCK_IDS:
                    yield close(kind)
                    block, first, keys, rows, size = block + 1, first + size, [], [], 0
                keys.append(key)
                rows.append(ids)
                size += len(ids)
        if rows:
            yield close(kind)

    ordered = encoded.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    blocks = map_batches(
        ordered,
        work,
        f"part long, block long, first long, doc_ids array<{id_type}>, lengths array<bigint>, "
        "control binary, data binary",
    )
    blocks.write.option("compression", "zstd").parquet(f"{out}/blocks")
    ranks = spark.createDataFrame(
        [(r, int(i)) for r, i in enumerate(by_rank)], "rank long, id long"
    )
    ranks.coalesce(1).write.parquet(f"{out}/ranks")


def read_token_files(spark: SparkSession, out: str) -> DataFrame:
    """``doc_id, start, ids`` of every document; ``start`` counts the ids of all documents before."""
    blocks = spark.read.parquet(f"{out}/blocks")
    ranks = spark.read.parquet(f"{out}/ranks").collect()  # one per vocabulary entry
    id_of = np.empty(len(ranks), "<u4")
    for row in ranks:
        id_of[row.rank] = row.id
    table = spark.sparkContext.broadcast(id_of)
    size = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    # A row per part; there are as many as the range exchange had partitions.
    parts = blocks.groupBy("part").agg(F.max(F.col("first") + size).alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow - 1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    start = (F.col("first") + F.col("ahead")).alias("start")
    id_type = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                keys, lengths, control, data, start = (c[row].as_py() for c in batch.columns)
                ids = table.value[decode_values(control, data, sum(lengths))].astype("<u4")
                ends = np.cumsum(lengths)
                begin = ends - lengths
                raw = [ids[a:b].tobytes() for a, b in zip(begin, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, batch.schema.field(0).type.value_type),
                        pa.array(begin + start, pa.int64()),
                        pa.array(raw, pa.binary()),
                    ],
                    ["doc_id", "start", "ids"],
                )

    placed = blocks.join(F.broadcast(parts), "part")
    return map_batches(
        placed.select("doc_ids", "lengths", "control", "data", start),
        work,
        f"doc_id {id_type}, start long, ids binary",
    )


def digest(read: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of documents read from token files."""
    return read.select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )
