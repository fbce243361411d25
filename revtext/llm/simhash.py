"""SimHash near-duplicates, found by covering locality-sensitive hashing.

A fingerprint has a bit set where more than half of the shingle hashes have it.
Bits are dealt over the non-zero vectors of GF(2)^(r+1), r the radius; table v
keeps the bits whose vector has an odd product with v. Up to r differing bits
span at most r dimensions, so some v is orthogonal to all of them, and its
table shows both fingerprints with equal kept bits: no pair is missed.

Equal fingerprints are one node. Inside a bucket nodes are linked through the
points halfway between them: two nodes differ in at most r bits exactly if
some point lies within r/2 flips of both. A point has a bounded number of
nodes around it, so a bucket of any size is worked off without forming pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revtext.llm.batches import map_batches, utf8
from revtext.llm.components import components
from revtext.storage import stage

BITS = 64
SHINGLE = 3
RADIUS = 2
SEED = 42
SLICE = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text as an unsigned 64-bit number; without words 0."""
    words = text.lower().split()
    if not words:
        return 0
    spans = [words[i:] for i in range(min(shingle, len(words)))]
    grams = map(b" ".join, zip(*spans, strict=False))
    total = max(1, len(words) - shingle + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, total)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, total, SLICE):
        octets = hashes[at : at + SLICE].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *keys: str, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``keys`` and ``fp`` (the bits as a signed long) of every row. A null text counts as empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, shingle) for t in utf8(batch.column(len(keys)))]
            signed = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], signed], [*keys, "fp"])

    rows = docs.select(*keys, text)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[: len(keys)])
    return map_batches(rows, work, f"{kinds}, fp long")


def covering_masks(radius: int = RADIUS) -> list[int]:
    """The kept bits of each table, as signed longs."""
    vectors = 2 ** (radius + 1) - 1
    masks = []
    for v in range(1, vectors + 1):
        bits = (b for b in range(BITS) if ((b % vectors + 1) & v).bit_count() % 2)
        masks.append(_signed(sum(1 << b for b in bits)))
    return masks


def _signed(bits: int) -> int:
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def _halfway(fp: Column, mask: int, flips: int) -> Column:
    """The points within ``flips`` flips of ``fp`` that only change bits outside ``mask``."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    sets = [s for n in range(flips + 1) for s in combinations(free, n)]
    changes = [_signed(sum(1 << b for b in s)) for s in sets]
    return F.transform(F.array(*map(F.lit, changes)), lambda x: fp.bitwiseXOR(x))


def covering_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``u, v`` that join distinct fingerprints ``fp`` of ``nodes`` at most ``radius`` bits apart.

    Buckets of two are compared directly. Larger ones are dealt by the points
    halfway between their members; the members around a point form a star.
    ``radius`` must be even.
    """
    if radius < 2 or radius % 2:
        raise ValueError("radius must be even and at least 2")
    masks = covering_masks(radius)
    keyed = nodes.select(
        "fp",
        F.explode(
            F.array(
                *(
                    F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                    for t, m in enumerate(masks)
                )
            )
        ).alias("b"),
    ).select("fp", "b.t", "b.key")
    buckets = keyed.groupBy("t", "key").agg(
        F.count(F.lit(1)).alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")
    )
    buckets = stage(buckets.where("n > 1"), "buckets")
    apart = F.bit_count(F.col("u").bitwiseXOR(F.col("v")))
    pairs = buckets.where((F.col("n") == 2) & (apart <= radius)).select("u", "v")
    crowded = keyed.join(buckets.where("n > 2").select("t", "key"), ["t", "key"])
    points = F.lit(None).cast("array<bigint>")
    for t, m in enumerate(masks):
        points = F.when(F.col("t") == t, _halfway(F.col("fp"), m, radius // 2)).otherwise(points)
    stars = (
        crowded.select("t", "fp", F.explode(points).alias("point"))
        .groupBy("t", "point")
        .agg(F.collect_set("fp").alias("near"))
        .where(F.size("near") > 1)
        .select(F.array_min("near").alias("u"), F.explode("near").alias("v"))
        .where("u <> v")
    )
    return pairs.union(stars).distinct()


def near_classes(prints: DataFrame, id_col: str, radius: int = RADIUS) -> DataFrame:
    """``prints`` (``id_col``, ``fp``) with ``component_id``, the least id reachable over links.

    Links join rows whose fingerprints differ in at most ``radius`` bits.
    Rows of one fingerprint are reduced to a node before any shuffle of
    candidates; the last join carries ids and fingerprints only. Null ids are
    passed over by the minimum: a class of null ids alone has a null id.
    ``prints`` is read several times and should be stored.
    """
    nodes = stage(prints.groupBy("fp").agg(F.min(id_col).alias("least_id")), "nodes")
    member = components(covering_links(nodes, radius)).withColumnRenamed("node", "fp")
    linked = member.join(nodes, "fp").select("fp", "root", "least_id")
    linked = stage(linked, "members")
    least = linked.groupBy("root").agg(F.min("least_id").alias("class_id"))
    linked = linked.join(least, "root").select("fp", "class_id")
    classes = nodes.join(linked, "fp", "left").select(
        "fp", F.coalesce("class_id", "least_id").alias("component_id")
    )
    return prints.join(classes, "fp")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs``.

    Null texts and texts without words have fingerprint zero and link like any
    other. Repeated rows come out repeated. An empty table gives an empty
    result. Columns besides ``doc_id`` and ``text`` are not read.
    """
    prints = stage(fingerprints(docs, "doc_id", shingle=shingle), "prints")
    return near_classes(prints, "doc_id", radius).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each class stays: that of the least ``doc_id``, nulls last, then the first stored.

    All columns of ``docs`` come out as they were. Rows get an internal number
    in a stored copy, so that repeated ids and repeated rows count as rows.
    """
    columns = docs.columns
    row = "_row_of_docs"
    stored = stage(docs.withColumn(row, F.monotonically_increasing_id()), "docs")
    prints = stage(fingerprints(stored, "doc_id", row, shingle=shingle), "prints")
    classes = near_classes(prints, row, radius)
    order = F.struct(F.col("doc_id").isNull().alias("a"), "doc_id", row)
    kept = classes.groupBy("component_id").agg(F.min(order).alias("first")).select(f"first.{row}")
    return stored.join(kept, row, "left_semi").select(*(F.col(f"`{c}`") for c in columns))
