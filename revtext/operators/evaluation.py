"""Evaluation that a frequent class can't flatter: area under the curve, confusion, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revtext.functions.labels import class_of
from revtext.storage import stage

BINS = 10


def auc(rows: DataFrame) -> DataFrame:
    """``class, positives, negatives, auc`` of rows ``class, score, positive``, one per class.

    The share of pairs of a positive and a negative row of the class in which the positive one scores
    higher, a tie counting half. Equal scores are added up first, so that they are one row; scores
    are dealt by range and counted behind the sums of the ranges before. Exact: counts are whole
    numbers up to the last division. Null scores and labels are left out; a class without
    positive or without negative rows has a null area.
    """
    known = rows.where(F.col("score").isNotNull() & F.col("positive").isNotNull())
    hits = F.col("positive").cast("long")
    tied = known.groupBy("class", "score").agg(F.sum(hits).alias("pos"), F.sum(1 - hits).alias("neg"))
    dealt = tied.repartitionByRange("class", "score").withColumn("range", F.spark_partition_id())
    dealt = stage(dealt, "auc-ranges")
    # A row per range, and per class that begins in it.
    sums = dealt.groupBy("class", "range").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    of_class = Window.partitionBy("class")
    sums = sums.select(
        "class",
        "range",
        (F.sum("neg").over(of_class.orderBy("range")) - F.col("neg")).alias("before"),
        F.sum("pos").over(of_class).alias("positives"),
        F.sum("neg").over(of_class).alias("negatives"),
    )
    rising = Window.partitionBy("class", "range").orderBy("score")
    lower = dealt.withColumn("lower", F.sum("neg").over(rising) - F.col("neg")).join(sums, ["class", "range"])
    # Twice the pairs won, so that ties stay whole.
    won = F.col("pos").cast("decimal(18,0)") * (2 * (F.col("lower") + F.col("before")) + F.col("neg")).cast("decimal(19,0)")
    summed = lower.groupBy("class", "positives", "negatives").agg(F.sum(won).cast("double").alias("won"))
    pairs = 2.0 * F.col("positives") * F.col("negatives")
    return summed.select("class", "positives", "negatives", F.try_divide("won", pairs).alias("auc"))


def class_scores(scored: DataFrame, label: Column | None = None) -> DataFrame:
    """``class, score, positive``: each class of scored rows against the rest."""
    truth = class_of(F.col("label_ohe")) if label is None else label
    each = scored.select(truth.alias("truth"), F.posexplode("probability").alias("class", "score"))
    return each.select("class", "score", (F.col("class") == F.col("truth")).alias("positive"))


def confusion(scored: DataFrame, num_classes: int) -> DataFrame:
    """``label, prediction, n, share``: rows per pair of classes, also of pairs that do not occur.

    ``share`` is that of the label's rows; null for a label without rows.
    """
    counted = scored.groupBy(class_of(F.col("label_ohe")).alias("label"), "prediction").agg(F.count(F.lit(1)).alias("n"))
    classes = scored.sparkSession.range(num_classes * num_classes)  # a row per pair of classes
    every = classes.select(
        F.floor(F.col("id") / num_classes).cast("int").alias("label"), (F.col("id") % num_classes).cast("int").alias("prediction")
    )
    counted = counted.withColumns({c: F.col(c).cast("int") for c in ("label", "prediction")})
    full = every.join(counted, ["label", "prediction"], "left").fillna(0, ["n"])
    share = F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy("label")))
    return full.select("label", "prediction", "n", share.alias("share"))


def calibration(rows: DataFrame, bins: int = BINS) -> DataFrame:
    """``class, bin, n, mean_score, observed`` of rows ``class, score, positive``.

    Scores from 0 to 1 fall into ``bins`` of equal width, the last with its end; bins without rows are left out.
    ``observed`` is the share of positive rows, which calibrated scores match.
    """
    known = rows.where(F.col("score").isNotNull() & F.col("positive").isNotNull())
    at = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    return known.groupBy("class", at.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("score").alias("mean_score"),
        F.avg(F.col("positive").cast("double")).alias("observed"),
    )


def calibration_error(bins: DataFrame) -> DataFrame:
    """``class, n, error``: the mean distance of scores and observed shares, by rows."""
    gap = F.abs(F.col("mean_score") - F.col("observed")) * F.col("n")
    return bins.groupBy("class").agg(F.sum("n").alias("n"), (F.sum(gap) / F.sum("n")).alias("error"))
