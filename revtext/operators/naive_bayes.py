"""Multinomial naive Bayes over encoded reviews as aggregations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revtext.functions.labels import class_of
from revtext.functions.lookup import MAX_ENTRIES, constant_array
from revtext.functions.rules import bind
from revtext.operators.scoring import add_prediction
from revtext.schemas import VOCAB_SIZE, check_classes
from revtext.storage import stage

PRIOR_SLOT = 0


def class_word_counts(encoded: DataFrame) -> DataFrame:
    """Known-word occurrences per class, and rows per class at index 0.

    Index 0 never counts as a word, so its slot carries the row count: one
    scan and one shuffle of at most classes x (vocabulary + 1) groups per task.
    """
    known = F.filter("features", lambda i: i > 0)
    slots = F.concat(F.array(F.lit(PRIOR_SLOT)), known)
    words = encoded.select(
        class_of(F.col("label_ohe")).alias("class"), F.explode_outer(slots).alias("idx")
    )
    return words.groupBy("class", "idx").agg(F.count(F.lit(1)).alias("n"))


def _classes(spark: SparkSession, num_classes: int) -> DataFrame:
    return spark.range(num_classes).select(F.col("id").cast("int").alias("class"))


def class_priors(counts: DataFrame, num_classes: int) -> DataFrame:
    """Smoothed log prior of every class, also of classes without rows."""
    rows = counts.where(F.col("idx") == PRIOR_SLOT).select("class", "n")
    every = _classes(counts.sparkSession, num_classes).join(rows, "class", "left")
    n = F.coalesce("n", F.lit(0))
    total = F.sum(n).over(Window.partitionBy())
    return every.select(
        "class", n.alias("n"), (F.log(n + 1) - F.log(total + num_classes)).alias("log_prior")
    )


def word_likelihoods(counts: DataFrame, num_classes: int, vocab_size: int) -> DataFrame:
    """Smoothed log likelihood of every word index in every class."""
    words = counts.where(F.col("idx") != PRIOR_SLOT)
    totals = words.groupBy("class").agg(F.sum("n").alias("total"))
    grid = (
        _classes(counts.sparkSession, num_classes)
        .join(totals, "class", "left")
        .select(
            "class",
            F.coalesce("total", F.lit(0)).alias("total"),
            F.explode(F.sequence(F.lit(1), F.lit(vocab_size))).alias("idx"),
        )
    )
    n = F.coalesce("n", F.lit(0))
    loglik = F.log(n + 1) - F.log(F.col("total") + vocab_size)
    return grid.join(words, ["class", "idx"], "left").select(
        "class", "idx", n.alias("n"), loglik.alias("loglik")
    )


@dataclass
class NaiveBayesModel:
    """Parameter tables ``(class, n, log_prior)`` and ``(class, idx, n, loglik)``."""

    prior: DataFrame
    words: DataFrame
    num_classes: int
    vocab_size: int

    def scores(self, encoded: DataFrame) -> DataFrame:
        """Add ``scores``: the joint log likelihood of each class."""
        head = MAX_ENTRIES // self.num_classes
        if self.vocab_size > head:
            return self.scores_by_join(encoded, head)
        score = self._scores_in_place(self.vocab_size)
        return encoded.withColumn("scores", F.array(*[score(c) for c in range(self.num_classes)]))

    def _scores_in_place(self, head: int) -> Callable[[int], Column]:
        """Score of a class by the prior and the words up to index ``head``."""
        prior, weights = self.log_priors(), self.weights(head)

        def score(c: int) -> Column:
            table = constant_array(weights[c])
            return F.aggregate(
                "features",
                F.lit(prior[c]),
                lambda acc, i: acc + F.coalesce(F.get(table, i), F.lit(0.0)),
            )

        return score

    def weights(self, head: int | None = None) -> list[list[float]]:
        """Log likelihoods by class and index; index 0 weighs nothing."""
        size = min(head or self.vocab_size, self.vocab_size)
        table = [[0.0] * (size + 1) for _ in range(self.num_classes)]
        words = self.words.where(F.col("idx") <= size)
        for row in words.select("class", "idx", "loglik").collect():
            table[row["class"]][row.idx] = row.loglik
        return table

    def log_priors(self) -> dict[int, float]:
        return {row["class"]: row.log_prior for row in self.prior.collect()}

    def scores_by_join(self, encoded: DataFrame, head: int) -> DataFrame:
        """Scores for vocabularies of any size, over rows stored with a number of their own.

        Frequent words, those up to index ``head``, are scored in place. The
        rarer rest is counted per row and joined with one row per index that
        holds the weights of all classes.
        """
        classes, columns = range(self.num_classes), encoded.columns
        encoded = stage(encoded.withColumn("_row", F.monotonically_increasing_id()), "numbered")
        by_index = (
            self.words.where(F.col("idx") > head)
            .groupBy("idx")
            .agg(F.array_sort(F.collect_list(F.struct("class", "loglik"))).alias("weights"))
        )
        rare = F.filter("features", lambda i: i > head)
        words = encoded.select("_row", F.explode_outer(rare).alias("idx"))
        counted = words.where("idx IS NOT NULL").groupBy("_row", "idx").agg(
            F.count(F.lit(1)).alias("times")
        )
        sums = (
            counted.join(by_index, "idx")
            .groupBy("_row")
            .agg(
                *[
                    F.sum(F.col("times") * F.get("weights", F.lit(c))["loglik"]).alias(f"_s{c}")
                    for c in classes
                ]
            )
        )
        score = self._scores_in_place(head)
        scores = F.array(*[score(c) + F.coalesce(f"_s{c}", F.lit(0.0)) for c in classes])
        return encoded.join(sums, "_row", "left").select(
            *[F.col(c) for c in columns], scores.alias("scores")
        )

    def predict(self, encoded: DataFrame) -> DataFrame:
        """Add ``probability`` and ``prediction``."""
        scored = self.scores(encoded)
        return add_prediction(scored.withColumn("probability", softmax("scores")).drop("scores"))

    def save(self, path: str) -> None:
        self.prior.write.mode("overwrite").parquet(f"{path}/prior")
        self.words.write.mode("overwrite").parquet(f"{path}/words")


def softmax(scores: str) -> Column:
    """Probabilities of log scores, safe against underflow.

    The scores are named once, so that they are computed once wherever the optimiser puts them.
    """

    def shares(each: Column, top: Column) -> Column:
        total = F.aggregate(each, F.lit(0.0), lambda acc, s: acc + F.exp(s - top))
        return bind(F.log(total), lambda log_total: F.transform(each, lambda s: F.exp(s - top - log_total)))

    return bind(F.col(scores), lambda each: bind(F.array_max(each), lambda top: shares(each, top)))


def fit_naive_bayes(
    encoded: DataFrame, num_classes: int = 5, vocab_size: int | None = VOCAB_SIZE
) -> NaiveBayesModel:
    """Fit on encoded rows; both parameter tables are stored.

    ``vocab_size`` None takes the largest index of the rows. A larger index
    than ``vocab_size`` is an error, as its word would have no likelihood.
    """
    check_classes(num_classes)
    counts = stage(class_word_counts(encoded), "nb-counts")
    vocab_size = checked_size(counts.agg(F.max("idx")).first()[0], vocab_size)
    return NaiveBayesModel(
        stage(class_priors(counts, num_classes), "nb-prior"),
        stage(word_likelihoods(counts, num_classes, vocab_size), "nb-words"),
        num_classes,
        vocab_size,
    )


def checked_size(largest: int | None, vocab_size: int | None) -> int:
    """The number of words a model covers, at least the largest index seen."""
    largest = largest or 0
    if vocab_size is None:
        return max(1, largest)
    if largest > vocab_size:
        raise ValueError(f"index {largest} is beyond the vocabulary of {vocab_size} words")
    return vocab_size


def load_naive_bayes(spark: SparkSession, path: str) -> NaiveBayesModel:
    prior = spark.read.schema("class int, n long, log_prior double").parquet(f"{path}/prior")
    words = spark.read.schema("class int, idx int, n long, loglik double").parquet(f"{path}/words")
    vocab_size = words.agg(F.max("idx")).first()[0]
    return NaiveBayesModel(prior, words, prior.count(), vocab_size)
