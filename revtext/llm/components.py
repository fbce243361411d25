"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revtext.storage import stage


def _large_star(links: DataFrame) -> DataFrame:
    """Each node sends its larger neighbours to the least node it knows."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node sends itself and its smaller neighbours to the least of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(links: DataFrame) -> tuple:
    mixed = F.xxhash64("u", "v").cast("decimal(20,0)")
    return tuple(links.agg(F.count(F.lit(1)), F.sum(mixed)).first())


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (long columns ``u, v``); the root is the least node.

    Every round is written to the shared folder, so plans stay short and a
    lost executor costs its tasks only. The number of rounds grows with the
    logarithm of the longest chain. Only two numbers reach the driver.
    """
    links = stage(links.where("u <> v").distinct(), "links")
    before = _state(links)
    while True:
        links = stage(_small_star(_large_star(links)), "links")
        after = _state(links)
        if after == before:
            break
        before = after
    members = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return members.union(roots)
