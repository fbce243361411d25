"""Predictions from class probabilities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revtext.functions.labels import class_of
from revtext.functions.rules import bind
from revtext.schemas import MAX_LEN, SCORING_BATCH


def add_prediction(df: DataFrame, probability: str = "probability") -> DataFrame:
    """Add ``prediction``: the most probable class, first on ties."""
    return df.withColumn("prediction", bind(F.col(probability), class_of))


def score_batches(
    encoded: DataFrame,
    make_predict_fn: Callable,
    length: int = MAX_LEN,
    batch_size: int = SCORING_BATCH,
) -> DataFrame:
    """Score with an outside model, in batches of ``batch_size`` rows per call.

    ``make_predict_fn`` loads the model once per Python worker and returns a
    function from a float matrix of indices to a matrix of probabilities.
    """
    score = predict_batch_udf(
        make_predict_fn,
        return_type=T.ArrayType(T.DoubleType()),
        batch_size=batch_size,
        input_tensor_shapes=[[length]],
    )
    features = F.col("features").cast("array<float>")
    return add_prediction(encoded.withColumn("probability", score(features)))
