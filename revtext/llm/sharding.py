"""Shards of near equal bytes that keep equal texts together.

The smallest capacity that lets a contiguous partition of the ordered groups
fit into the shards is found by search, each trial checked greedily; the cuts
are the greedy ones at that capacity. Groups are ordered by the digest of their
text, so a document's shard follows from its digest and a few constants, and
neighbours in the input end up in different shards.

Groups as large as an equal share of what is left fix the capacity by
themselves. They come first in the order, a shard each, so that the capacity
found for the others is not hidden behind them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revtext.storage import stage

SHARDS = 8

#: Capacities tried at once. Each step of all their greedy checks is one aggregation.
TRIALS = 48

#: Leading hex digits of a digest that name a range of groups, or of a row's hash that name
#: a range of slots.
RANGE_DIGITS = 3


@dataclass(frozen=True)
class Cuts:
    """Where groups go: own shards of large groups, and the last digest of each later shard but one."""

    alone: tuple[str, ...]
    last: tuple[str, ...]
    capacity: int

    def shard(self, digest: Column) -> Column:
        """Shard of a group: large ones first, then by the number of cuts before the digest."""
        after = F.lit(len(self.alone))
        for cut in self.last:
            after = after + (digest > cut).cast("int")
        found = after
        for number, large in enumerate(self.alone):
            found = F.when(digest == large, number).otherwise(found)
        return found.cast("int")


def sized_rows(docs: DataFrame) -> DataFrame:
    """Id, bytes + 1, CRC-32 and digest of every text and a row number, stored without the texts.

    Null texts are a group of their own, with no bytes and the CRC of nothing.
    """
    data = F.col("text").cast("binary")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    return stage(
        docs.select(
            F.monotonically_increasing_id().alias("_row"),
            "doc_id",
            size.alias("size"),
            F.coalesce(F.crc32(data), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(F.sha2(data, 256), F.lit("null")).alias("digest"),
        ),
        "shard-sizes",
    )


def group_sizes(sized: DataFrame) -> DataFrame:
    """``digest, bytes`` per group of equal texts; added up in each task before the exchange."""
    return sized.groupBy("digest").agg(F.sum("size").alias("bytes"))


def _ends(groups: DataFrame) -> DataFrame:
    """``digest, end``: bytes of the groups up to each, in order of their digests.

    Digests spread evenly over their leading digits, so each range is one small
    window; the sums of the ranges before are one row per range.
    """
    part = F.substring("digest", 1, RANGE_DIGITS)
    groups = groups.withColumn("range", part)
    sums = groups.groupBy("range").agg(F.sum("bytes").alias("bytes"))
    # At most 16 ** RANGE_DIGITS + 1 rows.
    before = sums.select("range", (F.sum("bytes").over(Window.orderBy("range")) - F.col("bytes")).alias("before"))
    running = F.sum("bytes").over(Window.partitionBy("range").orderBy("digest"))
    ends = groups.withColumn("running", running).join(F.broadcast(before), "range")
    return ends.select("digest", (F.col("before") + F.col("running")).alias("end"))


def _greedy(
    ends: DataFrame, capacities: list[int], total: int, largest: int, cuts: int
) -> list[list[int]]:
    """The first ``cuts`` greedy ends of each capacity.

    One aggregation per step finds the last end within reach of every trial. No
    group is larger than ``largest``, so only ends that near to a reach are read.
    """
    found: list[list[int]] = [[] for _ in capacities]
    for _ in range(cuts):
        reach = [min((e[-1] if e else 0) + c, total) for e, c in zip(found, capacities, strict=True)]
        near = ends.where(F.col("end").between(min(reach) - largest, max(reach)))
        best = near.agg(*(F.max(F.when(F.col("end") <= r, F.col("end"))) for r in reach)).first()
        for e, b in zip(found, best, strict=True):
            e.append(b)
    return found


def _smallest_capacity(ends: DataFrame, total: int, largest: int, shards: int) -> tuple[int, list[int]]:
    """The least capacity at which ``shards`` greedy shards hold everything, and its cuts."""
    low = max(largest, -(-total // shards))
    high = low + largest  # a greedy shard leaves less than the largest group of an equal share
    at_high: list[int] | None = None
    while low < high or at_high is None:
        step = max(1, math.ceil((high - low + 1) / TRIALS))
        trials = sorted({*range(low, high, step), high})
        cuts = _greedy(ends, trials, total, largest, shards - 1)
        for k, (capacity, at) in enumerate(zip(trials, cuts, strict=True)):
            if total - (at[-1] if at else 0) <= capacity:
                high, at_high = capacity, at
                low = trials[k - 1] + 1 if k else capacity
                break
    return high, at_high


def find_cuts(sized: DataFrame, shards: int = SHARDS) -> Cuts:
    """Cuts of the rows of ``sized_rows`` into ``shards``.

    The driver sees the ``shards`` largest groups, a number per trial and step, and
    the cuts.
    """
    groups = stage(group_sizes(sized), "shard-groups")
    left = groups.agg(F.sum("bytes")).first()[0] or 0
    alone: list[str] = []
    for row in groups.orderBy(F.desc("bytes"), "digest").limit(shards).collect():
        if len(alone) == shards - 1 or row.bytes * (shards - len(alone)) < left:
            largest = row.bytes
            break
        alone.append(row.digest)
        left -= row.bytes
    else:
        return Cuts(tuple(alone), (), 0)
    rest = groups.where(~F.col("digest").isin(alone)) if alone else groups
    ends = stage(_ends(rest), "shard-ends")
    capacity, cuts = _smallest_capacity(ends, left, largest, shards - len(alone))
    last = [r.digest for r in ends.where(F.col("end").isin(cuts)).orderBy("end").collect()] if cuts else []
    return Cuts(tuple(alone), tuple(last), capacity)


def with_slots(placed: DataFrame) -> DataFrame:
    """Add ``slot``: gapless numbers from 0 in each ``shard``.

    Rows are numbered by a hash of text and id, in ranges of hashes behind the
    counts of the ranges before; copies of a text have ids of their own and so
    spread over the ranges. Rows without one go by their stored number.
    """
    number = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row"), F.col("_row").cast("string")))
    key = F.md5(F.concat_ws(":", "digest", number))
    placed = placed.withColumn("_hash", key).withColumn("_range", F.substring("_hash", 1, RANGE_DIGITS))
    counts = placed.groupBy("shard", "_range").agg(F.count(F.lit(1)).alias("rows"))
    # At most 16 ** RANGE_DIGITS rows a shard.
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("_range")) - F.col("rows")
    before = counts.select("shard", "_range", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "_range").orderBy("_hash", "_row")) - 1
    numbered = placed.withColumn("_within", within).join(F.broadcast(before), ["shard", "_range"])
    slot = (F.col("before") + F.col("_within")).cast("long")
    return numbered.select(*(c for c in placed.columns if not c.startswith("_")), slot.alias("slot"))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row.

    Equal texts share a shard, empty ones included; null texts are a group of
    their own. Null and repeated ids are rows like any other. No shard holds more bytes
    than it must, given that order of the groups. With fewer groups than shards,
    some stay empty; an empty table gives an empty result. Texts may be of any length;
    other columns are not read.
    """
    sized = sized_rows(docs)
    cuts = find_cuts(sized, shards)
    return with_slots(sized.withColumn("shard", cuts.shard(F.col("digest")))).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
