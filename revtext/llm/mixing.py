"""Mixing sources to target weights by capped water-filling, in DataFrame operations.

All sources share the words of the corpus by weight. A source is held at
``max_epochs`` times its own words, and what that leaves over is shared again
by weight. With sources ordered by cap / weight, the water level is where the
caps below it and the weights above it use up the budget, so no loop is needed.

Whole repetitions are counts. The fractional one takes documents in the order
of a seeded hash: a histogram over the first digits of the hash finds the
bucket in which a source's share runs out, and only documents of that bucket
are ranked, so no task orders a whole source. At last the one document that
best fits what is still missing is added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revtext.storage import stage

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 17
#: Hexadecimal digits of the hash that number the histogram's buckets.
BUCKET_DIGITS = 3

ROW = "_row_to_mix"


def word_count(text: Column) -> Column:
    """Number of words, which ASCII white space parts; a null text has none."""
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return F.coalesce(words, F.lit(0)).cast("long")


def draw(key: Column, seed: int = SEED) -> Column:
    """Seeded hash of a row key as 32 hexadecimal digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary"))


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """``source, source_size, target`` from rows ``source, size``.

    Weights go round over the sources by code point, null last. One row per
    source is ordered in one task; documents are added up before.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("long")
    cap = (F.col("source_size") * max_epochs).alias("cap")
    capped = per.select("source", "source_size", weight.alias("w"), cap)
    everything = Window.partitionBy()
    fills = F.col("cap") / F.col("w")
    rising = Window.orderBy(fills, F.col("source").asc_nulls_last())
    below = rising.rowsBetween(Window.unboundedPreceding, Window.currentRow - 1)

    def rest(name: str, total: str) -> Column:
        return F.sum(total).over(everything) - F.coalesce(F.sum(name).over(below), F.lit(0))

    # The level if all sources before this one are full; the first that holds is the level.
    levels = capped.select("*", (rest("cap", "source_size") / rest("w", "w")).alias("water"))
    holds = F.when(F.col("water") <= fills, F.struct(fills.alias("fills"), "water"))
    found = levels.select("*", F.min(holds).over(everything)["water"].alias("level"))
    share = F.least(F.col("level") * F.col("w"), F.col("cap").cast("double"))
    return found.select("source", "source_size", share.alias("target"))


def _of_source(left: DataFrame, right: DataFrame, kind: str = "inner") -> DataFrame:
    """Join on ``source``, null like any other; ``right`` has one row per source."""
    right = right.withColumnRenamed("source", "_source")
    return left.join(right, F.col("source").eqNullSafe(F.col("_source")), kind).drop("_source")


def plan_mix(
    sized: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS
) -> tuple[DataFrame, DataFrame]:
    """The mix of stored rows ``ROW, source, size, draw``.

    First result, a row per source: ``source_size, target``, whole repetitions
    ``whole`` and the bucket ``cut`` below which rows are taken once more.
    Second: the ``ROW`` of the rows that are taken once more besides.
    """
    bucket = F.substring("draw", 1, BUCKET_DIGITS).alias("bucket")
    histogram = sized.groupBy("source", bucket).agg(F.sum("size").alias("size"))
    histogram = stage(histogram, "mix-histogram")
    whole = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long")
    targets = source_targets(histogram, weights, max_epochs).withColumn("whole", whole)
    share = F.col("target") - F.col("whole") * F.col("source_size")
    running = Window.partitionBy("source").orderBy("bucket")  # at most 16 ** BUCKET_DIGITS rows
    filled = histogram.withColumn("upto", F.sum("size").over(running))
    over = _of_source(filled, targets).where(F.col("upto") > share)
    first = F.min(F.struct("bucket", (share - F.col("upto") + F.col("size")).alias("left")))
    cuts = over.groupBy("source").agg(first.alias("c"))
    sources = _of_source(targets, cuts, "left").select(
        "source", "source_size", "target", "whole", F.col("c.bucket").alias("cut"), F.col("c.left").alias("left")
    )
    sources = stage(sources, "mix-sources")
    rows = sized.select(ROW, "source", "size", "draw", bucket)
    rows = _of_source(rows, sources.select("source", "cut", "left")).where("bucket >= cut")
    ranked = Window.partitionBy("source").orderBy("draw", "size", ROW)
    at_cut = rows.where("bucket = cut").withColumn("upto", F.sum("size").over(ranked))
    at_cut = stage(at_cut, "mix-cut")
    taken = at_cut.where("upto <= left")
    missing = taken.groupBy("source").agg(F.sum("size").alias("got"))
    missing = _of_source(sources.select("source", "left"), missing, "left").select(
        "source", (F.col("left") - F.coalesce("got", F.lit(0))).alias("missing")
    )
    names = (ROW, "source", "size", "draw")
    others = rows.where("bucket > cut").select(*names).union(at_cut.where("upto > left").select(*names))
    off = F.abs(F.col("size") - F.col("missing"))
    fits = _of_source(others, missing).where(off < F.col("missing"))
    best = fits.groupBy("source").agg(F.min(F.struct(off.alias("off"), "draw", ROW)).alias("b"))
    more = taken.select(ROW).union(best.select(F.col(f"b.{ROW}").alias(ROW)))
    return sources, stage(more, "mix-more")


def copies(sized: DataFrame, sources: DataFrame, more: DataFrame) -> DataFrame:
    """``sized`` with its source's columns and ``copies``, how often the mix takes the row."""
    marked = _of_source(sized, sources).join(more.withColumn("more", F.lit(1)), ROW, "left")
    once = F.substring("draw", 1, BUCKET_DIGITS) < F.col("cut")
    again = F.coalesce(once | F.col("more").isNotNull(), F.lit(False))
    return marked.withColumn("copies", F.col("whole") + again.cast("long"))


def sized_rows(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Row number, id, source, words and seeded hash of every row, stored."""
    return stage(
        docs.select(
            F.monotonically_increasing_id().alias(ROW),
            "doc_id",
            "source",
            word_count(F.col("text")).alias("size"),
            draw(F.col("doc_id"), seed).alias("draw"),
        ),
        "mix-sizes",
    )


def mixture(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED
) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` (words the mix takes) of every row of ``docs``.

    Null texts have size 0; null sources are a source. Rows of one id get one
    hash, and the smaller ones go first. A source without words has target 0.
    An empty table gives an empty result; other columns are not read.
    """
    sized = sized_rows(docs, seed)
    counted = copies(sized, *plan_mix(sized, weights, max_epochs))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return counted.select("doc_id", "size", "source_size", "target", taken)


def mixed(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED
) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, columns as they were.

    Joins bring a few columns to the stored rows; they are broadcast joins by
    themselves where the stored side is small enough.
    """
    columns = docs.columns
    names = {c: f"_{i}" for i, c in enumerate(columns)}
    stored = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    stored = stage(stored.withColumn(ROW, F.monotonically_increasing_id()), "mix-docs")
    size = word_count(F.col(names["text"])).alias("size")
    key = draw(F.col(names["doc_id"]), seed).alias("draw")
    source = F.col(names["source"]).alias("source")
    sized = stage(stored.select(ROW, source, size, key), "mix-sizes")
    sources, more = plan_mix(sized, weights, max_epochs)
    counted = copies(stored.select("*", source, key), sources, more).where("copies > 0")
    repeated = counted.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select(*(F.col(n).alias(c) for c, n in names.items()))
