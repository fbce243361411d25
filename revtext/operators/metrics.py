"""Accuracy and cross-entropy of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revtext.functions.labels import class_of

# Fixed value: probabilities are kept this far from 0 and 1.
EPSILON = 1e-7


def accuracy(prediction: Column, label: Column) -> Column:
    """Share of rows whose prediction equals the label."""
    return F.avg((prediction == label).cast("double"))


def log_loss(probability: Column, label: Column, epsilon: float = EPSILON) -> Column:
    """Mean cross-entropy of the probability given to the true class."""
    given = F.get(probability, label)
    return -F.avg(F.log(F.least(F.greatest(given, F.lit(epsilon)), F.lit(1 - epsilon))))


def evaluate_predictions(scored: DataFrame) -> DataFrame:
    """One row: rows scored, accuracy and log loss."""
    label = class_of(F.col("label_ohe"))
    return scored.agg(
        F.count(F.lit(1)).alias("n"),
        accuracy(F.col("prediction"), label).alias("accuracy"),
        log_loss(F.col("probability"), label).alias("log_loss"),
    )
