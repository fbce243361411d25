"""A Merkle manifest: one digest per document, one root per source and one over all.

Nodes of a tree are labelled so that every child comes before its parent, and
digests travel forward along the labels: a node takes what its children have
queued for it, and queues its own digest for its parent. The sweep back takes the
labels in reverse and hands every node the siblings above it, up to the leaves.

The queue has two halves. Between tasks, Spark's sorted exchange deals nodes by
blocks of whole subtrees, ``FAN ** LEVELS`` leaves each, in label order, and may spill. Inside
a block a heap holds the digests under way, at most ``FAN`` a level. The roots of
blocks are the leaves of the next round, so a tree of n leaves takes as many rounds as it has
``LEVELS`` levels, whatever its share of all rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revtext.storage import stage

FAN = 16

#: Levels of a tree that one round climbs.
LEVELS = 3

#: Fields of a document, in the order in which they are digested.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: Rows of an Arrow batch that goes back to Spark.
OUT_ROWS = 1024

#: A step of a proof: the node's place in its run and the other digests of the run.
PROOF = "array<struct<at:int,siblings:string>>"
_PROOF_ARROW = pa.list_(pa.struct([("at", pa.int32()), ("siblings", pa.string())]))

#: The tree over the roots of all sources.
_TOP = "top"


def field_bytes(value: Column) -> Column:
    """A field with its UTF-8 length in front; null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(field_bytes, fields)), 256)


def ascii_lower(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def fold_proof(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf and its proof, to be compared with the manifest's."""

    def step(below: Column, at: Column) -> Column:
        cut = at["at"] * 64
        before, after = F.substring(at["siblings"], F.lit(1), cut), F.substring(at["siblings"], cut + 1, F.lit(64 * FAN))
        return F.sha2(F.concat(before, below, after), 256)

    return F.aggregate(proof, leaf, step)


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings of a proof, from the leaf up, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda p: p["siblings"]), ""), 256)


# One block: the sweeps over its labels


def _nodes(leaves: int, levels: int) -> Iterator[tuple[int, int]]:
    """Labels (last leaf below, level) of a block's nodes in rising order."""
    for last in range(leaves):
        yield last, 0
        for level in range(1, levels + 1):
            if (last + 1) % FAN**level and last + 1 < leaves:
                break
            yield last, level


def _parent(last: int, level: int, leaves: int) -> tuple[int, int]:
    span = FAN ** (level + 1)
    return min(last - last % span + span, leaves) - 1, level + 1


def sweep_up(digests: list[str], levels: int) -> dict[tuple[int, int], list[str]]:
    """Digests of the children of each inner node, by label; leaves have their own."""
    queue: list[tuple[tuple[int, int], int, str]] = []
    children: dict[tuple[int, int], list[str]] = {}
    for label in _nodes(len(digests), levels):
        taken = []
        while queue and queue[0][0] == label:
            taken.append(heapq.heappop(queue)[2])
        digest = sha256("".join(taken).encode()).hexdigest() if label[1] else digests[label[0]]
        children[label] = taken or [digest]
        heapq.heappush(queue, (_parent(*label, len(digests)), label[0], digest))
    return children


def block_root(digests: list[str], levels: int) -> str:
    root = sweep_up(digests, levels)[len(digests) - 1, levels]
    return sha256("".join(root).encode()).hexdigest() if levels else root[0]


def sweep_down(digests: list[str], levels: int, above: list[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
    """Proofs of a block's leaves, last leaf first; ``above`` is the proof of its root."""
    leaves = len(digests)
    children = sweep_up(digests, levels)
    # Labels fall in this sweep, so the queue holds their negatives.
    queue = [((1 - leaves, -levels), above)]
    while queue:
        (last, level), proof = heapq.heappop(queue)
        last, level = -last, -level
        if not level:
            yield proof
            continue
        run = children[last, level]
        first = last - last % FAN**level
        for at, _ in enumerate(run):
            child = min(first + (at + 1) * FAN ** (level - 1), leaves) - 1
            step = (at, "".join(run[:at] + run[at + 1 :]))
            heapq.heappush(queue, ((-child, 1 - level), [step, *proof]))


def _climb(n: int) -> int:
    """Levels that a block climbs in a round over trees of ``n`` nodes."""
    levels = 0
    while n > 1 and levels < LEVELS:
        n, levels = -(-n // FAN), levels + 1
    return levels


# Rounds: blocks of all trees


def _blocks(nodes: DataFrame) -> DataFrame:
    """Nodes dealt by block, in label order within each task."""
    block = F.floor(F.col("pos") / F.lit(FAN**LEVELS)).cast("long")
    dealt = nodes.withColumn("block", block).repartition("tree", "block")
    return dealt.sortWithinPartitions("tree", "block", "pos")


def _rows_of(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(name).to_pylist() for name in names), strict=True)


def _round_up(nodes: DataFrame) -> DataFrame:
    """``tree, n, pos, digest`` of the blocks' roots: the nodes of the next round."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _rows_of(batches, ("tree", "block", "n", "digest"))
        found: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = zip(*found, strict=True)
            return pa.record_batch(dict(zip(("tree", "n", "pos", "digest"), map(list, columns), strict=True)))

        for (tree, block, n), members in groupby(rows, key=lambda r: r[:3]):
            levels = _climb(n)
            found.append((tree, -(-n // FAN**levels), block, block_root([m[3] for m in members], levels)))
            if len(found) == OUT_ROWS:
                yield batch()
                found.clear()
        if found:
            yield batch()

    columns = _blocks(nodes.select("tree", "n", "pos", "digest")).select("tree", "block", "n", "digest")
    return columns.mapInArrow(work, "tree string, n long, pos long, digest string")


def _round_down(nodes: DataFrame, proofs: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """``tree, pos, digest``, carried columns, ``subroot`` and ``proof`` of every node, given those of its block's root.

    They travel to the block ahead of its nodes, once, rather than with each.
    """
    fields = {f.name: f.dataType.simpleString() for f in nodes.schema} | {"subroot": "string", "proof": PROOF}
    of_node, of_block = ("n", "digest", *carried), ("subroot", "proof")
    block = F.floor(F.col("pos") / F.lit(FAN**LEVELS)).cast("long").alias("block")
    missing = {c: F.lit(None).cast(fields[c]).alias(c) for c in (*of_node, *of_block)}
    below = nodes.select("tree", block, "pos", *of_node, *(missing[c] for c in of_block))
    above = proofs.select(
        "tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), *(missing[c] for c in of_node), *of_block
    )
    dealt = below.unionByName(above).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
    kept = ("tree", "pos", "digest", *carried, "subroot")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: dict[str, pa.DataType] = {}

        def typed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                types.update(zip(batch.schema.names, batch.schema.types, strict=True))
                yield batch

        found: list[tuple[tuple, list[tuple[int, str]]]] = []

        def batch() -> pa.RecordBatch:
            columns = zip(*(row for row, _ in found), strict=True)
            arrays = [pa.array(list(v), types[name]) for name, v in zip(kept, columns, strict=True)]
            return pa.RecordBatch.from_arrays([*arrays, _proof_array([p for _, p in found])], [*kept, "proof"])

        rows = _rows_of(typed(), ("tree", "block", "pos", *of_node, *of_block))
        for _, (first, *leaves) in groupby(rows, key=lambda r: r[:2]):
            *_, subroot, proof = first
            above = [(step["at"], step["siblings"]) for step in proof]
            down = sweep_down([row[4] for row in leaves], _climb(leaves[0][3]), above)
            for (tree, _, pos, _, digest, *more), leaf_proof in zip(reversed(leaves), down, strict=True):
                found.append(((tree, pos, digest, *more[: len(carried)], subroot), leaf_proof))
                if len(found) == OUT_ROWS:
                    yield batch()
                    found.clear()
        if found:
            yield batch()

    result = {"tree": "string", "pos": "long"} | {c: fields[c] for c in ("digest", *carried, *of_block)}
    return dealt.mapInArrow(work, ", ".join(f"{c} {t}" for c, t in result.items()))


def _proof_array(proofs: list[list[tuple[int, str]]]) -> pa.Array:
    offsets = [0]
    for proof in proofs:
        offsets.append(offsets[-1] + len(proof))
    steps = [step for proof in proofs for step in proof]
    at = pa.array([s[0] for s in steps], pa.int32())
    siblings = pa.array([s[1] for s in steps], pa.string())
    structs = pa.StructArray.from_arrays([at, siblings], fields=list(_PROOF_ARROW.value_type))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs).cast(_PROOF_ARROW)


def positions(rows: DataFrame, order: tuple[str, ...], label: str) -> DataFrame:
    """Add ``pos`` within ``tree`` by ``order`` and the size ``n`` of the tree, stored.

    Rows are dealt by ranges of tree and order, so one large tree lies in many ranges, and
    numbered within a range behind the counts of the ranges before.
    """
    dealt = rows.repartitionByRange("tree", *order).withColumn("range", F.spark_partition_id())
    dealt = stage(dealt, f"{label}-ranges")
    counts = dealt.groupBy("tree", "range").agg(F.count(F.lit(1)).alias("rows"))
    # A row per range, and per tree that begins in it.
    per_tree = Window.partitionBy("tree")
    before = F.sum("rows").over(per_tree.orderBy("range")) - F.col("rows")
    counts = counts.select("tree", "range", before.alias("before"), F.sum("rows").over(per_tree).alias("n"))
    within = F.row_number().over(Window.partitionBy("range", "tree").orderBy(*order)) - 1
    numbered = dealt.withColumn("within", within).join(counts, ["tree", "range"])
    pos = (F.col("before") + F.col("within")).cast("long")
    return stage(numbered.select(*rows.columns, pos.alias("pos"), "n"), label)


class Forest:
    """Trees over the rows of ``positions``: their roots, and the proof of every node."""

    def __init__(self, leaves: DataFrame, label: str):
        self.label, self.rounds = label, [leaves]
        most = leaves.agg(F.max("n")).first()[0] or 1
        while most > 1:
            self.rounds.append(stage(_round_up(self.rounds[-1]), f"{label}-nodes"))
            most = -(-most // FAN**LEVELS)

    def roots(self) -> DataFrame:
        """``tree, digest``."""
        return self.rounds[-1].select("tree", "digest")

    def proofs(self, above: DataFrame | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
        """``proof`` of every leaf with its carried columns; ``above`` holds ``tree, subroot, proof`` of the roots."""
        if above is None:
            none = F.lit(None).cast("string").alias("subroot"), F.array().cast(PROOF).alias("proof")
            above = self.rounds[-1].select("tree", *none)
        proofs = above.withColumn("pos", F.lit(0).cast("long"))
        for k, nodes in reversed(list(enumerate(self.rounds))):
            if k < len(self.rounds) - 1 or k == 0:
                proofs = _round_down(nodes, proofs, carried if k == 0 else ())
                if k:
                    proofs = stage(proofs, f"{self.label}-proofs")
        return proofs


def tree_of(source: Column) -> Column:
    """The name of a source's tree; null comes first, others by their bytes."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def leaf_rows(docs: DataFrame) -> DataFrame:
    """``tree, doc_id, leaf, tampered``: texts are read and digested here, and only here.

    ``tampered`` is the digest after lower-casing A-Z of the text where 5 divides the
    CRC-32 of the decimal id, else null.
    """
    fields = [F.col(c) for c in FIELDS]
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    tampered = F.when(changed, leaf_digest(*fields[:-1], ascii_lower(fields[-1])))
    return docs.select(
        tree_of(F.col("source")).alias("tree"), "doc_id", leaf_digest(*fields).alias("digest"), tampered.alias("tampered")
    )


def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, tampered, leaf, subroot, root, proof`` of every row of ``docs``.

    Null ids come first in a source, equal ids in order of their digests; a null
    source is a source of its own, before the others. Null fields are digested as such,
    unlike empty ones. A single leaf is its source's root, a single source's root the root
    of all. An empty table gives an empty result; other columns are not read. Texts may be
    of any length: only digests leave the scan.
    """
    leaves = positions(leaf_rows(docs), ("doc_id", "digest"), "merkle-leaves")
    sources = Forest(leaves, "merkle-source")
    subroots = sources.roots().select(F.lit(_TOP).alias("tree"), F.col("tree").alias("source"), "digest")
    over_all = Forest(positions(subroots, ("source",), "merkle-subroots"), "merkle-top")
    root = over_all.roots().first()
    carried = over_all.proofs(carried=("source",))
    above = stage(carried.select(F.col("source").alias("tree"), F.col("digest").alias("subroot"), "proof"), "merkle-above")
    return sources.proofs(above, ("doc_id", "tampered")).select(
        "doc_id",
        "tampered",
        F.col("digest").alias("leaf"),
        "subroot",
        F.lit(root.digest if root else None).cast("string").alias("root"),
        "proof",
    )


def digest(made: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of a manifest."""
    folded = fold_proof(F.coalesce("tampered", "leaf"), F.col("proof"))
    read = made.withColumn("proof_sha256", proof_digest(F.col("proof"))).withColumn("folded_root", folded)
    return read.select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )
