"""Training in slices with evaluation in between, which goes on where it broke off."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import Word2Vec
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revtext.operators.metrics import evaluate_predictions
from revtext.operators.spark_ml import (
    EMBEDDING,
    HIDDEN,
    SparkMLModel,
    known_words,
    parts_of_embedding,
    training_rows,
)
from revtext.operators.splitting import POINTS, point
from revtext.schemas import SEED, check_classes
from revtext.storage import is_finished, stage

#: Slices without a better loss on the evaluation rows after which training ends.
PATIENCE = 2


@dataclass
class Trained:
    """The model of the best slice, and a row per slice: ``slice, train_loss, loss, accuracy, best``."""

    model: SparkMLModel
    history: DataFrame


def _word_vectors(
    train: DataFrame, path: str, embedding: int, embedding_iter: int, partitions: int, seed: int
) -> PipelineModel:
    if is_finished(train.sparkSession, f"{path}/metadata"):
        return PipelineModel.load(path)
    vectors = Word2Vec(
        inputCol="words", outputCol="vector", vectorSize=embedding, minCount=1,
        maxIter=embedding_iter, numPartitions=partitions, seed=seed,
    )
    fitted = Pipeline(stages=[known_words(), vectors]).fit(train)
    fitted.write().overwrite().save(path)
    return PipelineModel.load(path)


def _stored(df: DataFrame, path: str) -> DataFrame:
    """The table at ``path``, written now unless it was finished before."""
    spark = df.sparkSession
    return spark.read.schema(df.schema).parquet(path) if is_finished(spark, path) else stage(df, "rows", path)


def train_in_slices(
    encoded: DataFrame,
    evaluation: DataFrame,
    path: str,
    num_classes: int = 5,
    slices: int = 10,
    steps: int = 10,
    batch_share: float = 1.0,
    block_size: int = 128,
    patience: int = PATIENCE,
    embedding: int = EMBEDDING,
    embedding_iter: int = 1,
    embedding_partitions: int | None = None,
    hidden: tuple[int, ...] | None = None,
    seed: int = SEED,
    num_partitions: int | None = None,
) -> Trained:
    """Perceptron over averaged word vectors, ``steps`` solver steps a slice, evaluated after each.

    A slice starts from the weights of the one before and reads ``batch_share`` of the rows, chosen by a
    hash of row and slice, in blocks of ``block_size``. Training ends after ``slices``, or after
    ``patience`` of them that did not lower the loss on ``evaluation``; the best one is the model.
    Word vectors are learned in ``embedding_partitions`` parts, None for a part for every ``EMBEDDING_ROWS`` rows.

    Word vectors, both sets of vectors and the weights after each slice are stored under
    ``path``. A call with the same path and arguments takes up finished slices; more ``slices`` go on behind
    them. Take another path for other rows or arguments.
    """
    spark = encoded.sparkSession
    layers = [embedding, *(hidden or HIDDEN[check_classes(num_classes)]), num_classes]
    words = _word_vectors(
        training_rows(encoded, num_classes, num_partitions), f"{path}/vectors", embedding, embedding_iter,
        parts_of_embedding(encoded, embedding_partitions), seed,
    )
    rows = words.transform(encoded).select("label_ohe", "vector")
    rows = _stored(rows.withColumn("row", F.monotonically_increasing_id()), f"{path}/train")
    held_back = _stored(words.transform(evaluation).select("label_ohe", "vector"), f"{path}/evaluation")

    def classifier(iterations: int, weights: list[float] | None) -> MultilayerPerceptronClassifier:
        made = MultilayerPerceptronClassifier(
            featuresCol="vector", layers=layers, maxIter=iterations, blockSize=block_size, seed=seed
        )
        return made.setInitialWeights(Vectors.dense(weights)) if weights else made

    def one_slice(number: int, weights: list[float] | None) -> DataFrame:
        chosen = rows
        if batch_share < 1:
            chosen = rows.where(point(F.col("row"), seed, f"slice-{number}") < int(batch_share * POINTS))
        fitted = classifier(steps, weights).fit(training_rows(chosen, num_classes, num_partitions, "vector"))
        scored = SparkMLModel(PipelineModel([fitted]))
        own = evaluate_predictions(scored.predict(rows)).first()
        other = evaluate_predictions(scored.predict(held_back)).first()
        row = (number, own.log_loss, other.log_loss, other.accuracy, [float(w) for w in fitted.weights])
        names = "slice int, train_loss double, loss double, accuracy double, weights array<double>"
        return spark.createDataFrame([row], names).coalesce(1)

    done = []
    for number in range(1, slices + 1):
        at = f"{path}/slice-{number}"
        if not is_finished(spark, at):
            stage(one_slice(number, done[-1].weights if done else None), "slice", at)
        done.append(spark.read.parquet(at).first())
        best = min(done, key=lambda r: (r.loss is None, r.loss, r.slice))
        if number - best.slice >= patience:
            break
    history = [(r.slice, r.train_loss, r.loss, r.accuracy, r.slice == best.slice) for r in done]
    # Solver steps from the best weights, none of them.
    last = classifier(0, best.weights).fit(training_rows(rows, num_classes, num_partitions, "vector"))
    names = "slice int, train_loss double, loss double, accuracy double, best boolean"
    model = SparkMLModel(PipelineModel([*words.stages, last]))
    return Trained(model, spark.createDataFrame(history, names))
