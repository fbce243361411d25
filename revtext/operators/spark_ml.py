"""Spark ML classifiers over encoded reviews."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import (
    CountVectorizerModel,
    HashingTF,
    NGram,
    SQLTransformer,
    VectorAssembler,
    Word2Vec,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revtext.functions.labels import class_of
from revtext.operators.naive_bayes import checked_size
from revtext.operators.scoring import add_prediction
from revtext.schemas import SEED, VOCAB_SIZE, check_classes

# Embedding width and hidden layers for 2 and 5 classes.
EMBEDDING = 128
#: Rows that one task learns word vectors from, unless told otherwise.
EMBEDDING_ROWS = 25_000
#: Rows of one task of a solver; more than so many for each given partition are spread over more tasks.
SOLVER_ROWS = 20_000
HIDDEN = {2: (128, 128), 5: (256, 128)}


@dataclass
class SparkMLModel:
    fitted: PipelineModel

    def predict(self, encoded: DataFrame) -> DataFrame:
        """Add ``probability`` and ``prediction``."""
        scored = self.fitted.transform(encoded).withColumn(
            "probability", vector_to_array("probability")
        )
        return add_prediction(scored.select(*encoded.columns, "probability"))

    def save(self, path: str) -> None:
        self.fitted.write().overwrite().save(path)


def load_spark_ml(path: str) -> SparkMLModel:
    return SparkMLModel(PipelineModel.load(path))


def known_words() -> SQLTransformer:
    """Known indices as strings; padding and unknown words go."""
    return SQLTransformer(
        statement="SELECT *, transform(filter(features, i -> i > 0), i -> string(i)) AS words "
        "FROM __THIS__"
    )


def training_rows(
    encoded: DataFrame, num_classes: int, num_partitions: int | None, features: str = "features"
) -> DataFrame:
    """Labelled rows of a stored table for a solver, which keeps its own copy.

    Every pass of a solver starts one task per partition: ``num_partitions``
    merges the tiny ones of a small table without a shuffle, None leaves them. A
    larger table keeps a partition for every ``SOLVER_ROWS`` rows, as far as it has so many.
    """
    label = class_of(F.col("label_ohe")).cast("double")
    # Naming the classes keeps those absent from the training rows.
    nominal = {"ml_attr": {"type": "nominal", "num_vals": check_classes(num_classes)}}
    rows = encoded.select(features, label.alias("label", metadata=nominal))
    return rows.coalesce(max(num_partitions, encoded.count() // SOLVER_ROWS)) if num_partitions else rows


def parts_of_embedding(encoded: DataFrame, given: int | None = None) -> int:
    """In how many parts word vectors are learned: as many as given, or one for every ``EMBEDDING_ROWS`` rows."""
    return 1 + encoded.count() // EMBEDDING_ROWS if given is None else given


def fit_logistic_regression(
    encoded: DataFrame,
    num_classes: int = 5,
    vocab_size: int | None = VOCAB_SIZE,
    max_iter: int = 100,
    tol: float = 1e-6,
    reg: float = 0.01,
    num_partitions: int | None = None,
    trigram_cells: int = 0,
) -> SparkMLModel:
    """Logistic regression over word counts.

    ``vocab_size`` None takes the largest index of the rows; a larger index
    than ``vocab_size`` is an error. With ``trigram_cells``, runs of three known words count too,
    hashed to that many cells; they are made in the scoring stage and stored nowhere.
    """
    largest = encoded.agg(F.max(F.array_max("features"))).first()[0]
    vocab_size = checked_size(largest, vocab_size)
    vocabulary = [str(i) for i in range(1, vocab_size + 1)]
    counts = CountVectorizerModel.from_vocabulary(vocabulary, "words", "counts")
    stages, used = [known_words(), counts], "counts"
    if trigram_cells:
        runs = NGram(n=3, inputCol="words", outputCol="runs")
        hashed = HashingTF(numFeatures=trigram_cells, inputCol="runs", outputCol="run_counts")
        stages += [runs, hashed, VectorAssembler(inputCols=["counts", "run_counts"], outputCol="both")]
        used = "both"
    classifier = LogisticRegression(featuresCol=used, maxIter=max_iter, tol=tol, regParam=reg)
    pipe = Pipeline(stages=[*stages, classifier])
    rows = training_rows(encoded, num_classes, num_partitions)
    return SparkMLModel(pipe.fit(rows))


def fit_perceptron(
    encoded: DataFrame,
    num_classes: int = 5,
    max_iter: int = 100,
    tol: float = 1e-6,
    block_size: int = 128,
    embedding: int = EMBEDDING,
    embedding_iter: int = 1,
    seed: int = SEED,
    num_partitions: int | None = None,
    embedding_partitions: int | None = None,
) -> SparkMLModel:
    """Perceptron over averaged word vectors learned from the same rows.

    Vectors are learned in ``embedding_partitions`` parts, whose results are
    averaged: more are faster and give other vectors, whatever the cluster. None
    takes a part for every ``EMBEDDING_ROWS`` rows.
    """
    classifier = MultilayerPerceptronClassifier(
        featuresCol="vector",
        layers=[embedding, *HIDDEN[check_classes(num_classes)], num_classes],
        maxIter=max_iter,
        tol=tol,
        blockSize=block_size,
        seed=seed,
    )
    rows = training_rows(encoded, num_classes, num_partitions)
    vectors = Word2Vec(
        inputCol="words",
        outputCol="vector",
        vectorSize=embedding,
        minCount=1,
        maxIter=embedding_iter,
        numPartitions=parts_of_embedding(encoded, embedding_partitions),
        seed=seed,
    )
    pipe = Pipeline(stages=[known_words(), vectors, classifier])
    return SparkMLModel(pipe.fit(rows))
