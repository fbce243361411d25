"""The user-facing jobs: prepare, train, evaluate, predict."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revtext.functions.cleaning import clean_text
from revtext.functions.labels import class_name, keep_labelled, stars_of
from revtext.functions.lemma import VerbLemmatizer
from revtext.functions.tokens import STOP_WORDS
from revtext.operators import abbreviations as abbr
from revtext.operators.metrics import evaluate_predictions
from revtext.operators.naive_bayes import NaiveBayesModel, fit_naive_bayes, load_naive_bayes
from revtext.operators.spark_ml import (
    SparkMLModel,
    fit_logistic_regression,
    fit_perceptron,
    load_spark_ml,
)
from revtext.operators.splitting import part_of, sample_rows, split_key, split_test
from revtext.operators.vocabulary import encode_tokens, flag_tokens, term_counts, vocabulary
from revtext.plans.encode import add_label, encode_reviews, review_tokens
from revtext.schemas import EVAL_FRACTION, MAX_LEN, SEED, TEST_FRACTION, VOCAB_SIZE
from revtext.sinks.datasets import (
    write_dictionary,
    write_encoded,
    write_predictions,
    write_raw_reviews,
    write_xy_csv,
)
from revtext.storage import releases_scratch, stage

Model = NaiveBayesModel | SparkMLModel


@dataclass(frozen=True)
class Prepared:
    """Data sets of one preparation run."""

    train: DataFrame
    evaluation: DataFrame
    test: DataFrame | None
    vocab: DataFrame
    num_classes: int
    vocab_size: int
    train_sample: DataFrame | None = None
    abbreviations: DataFrame | None = None


@dataclass(frozen=True)
class Settings:
    """What a preparation was made with, and where the tables lie that a later one builds on.

    Written last, so a folder without them was not finished.
    """

    num_classes: int
    max_len: int
    vocab_size: int
    test: float | None
    evaluation: float
    seed: int
    vocab_from_train_only: bool
    tokens: list[str]
    abbreviations: list[str]

    def write(self, spark: SparkSession, out: str) -> None:
        row = spark.range(1).select(F.lit(json.dumps(asdict(self))).alias("value"))
        row.coalesce(1).write.mode("overwrite").text(f"{out}/settings")

    @classmethod
    def read(cls, spark: SparkSession, out: str) -> Settings:
        return cls(**json.loads(spark.read.text(f"{out}/settings").first().value))


def keyed(reviews: DataFrame, key: str | None = "review_id", path: str | None = None) -> DataFrame:
    """Reviews with the key ``review_id``: the column ``key``, or a number stored with the rows.

    Generated numbers are written down once, so that every later step and
    every retry sees the same.
    """
    if key and key in reviews.columns:
        return reviews.withColumnRenamed(key, "review_id")
    if key and key != "review_id":
        raise ValueError(f"no column {key}")
    numbered = reviews.withColumn("review_id", F.monotonically_increasing_id())
    return stage(numbered, "keyed", path)


@releases_scratch
def prepare(
    reviews: DataFrame,
    out: str,
    num_classes: int = 5,
    max_len: int = MAX_LEN,
    vocab_size: int = VOCAB_SIZE,
    test: float | None = TEST_FRACTION,
    evaluation: float = EVAL_FRACTION,
    sample: float = 0.0,
    seed: int = SEED,
    fmt: str = "parquet",
    vocab_from_train_only: bool = False,
    stop_words: Iterable[str] = STOP_WORDS,
    lemmatizer: VerbLemmatizer | None = None,
    key: str | None = "review_id",
    learn_abbreviations: bool = False,
) -> Prepared:
    """Encode labelled reviews and write every data set under ``out``.

    ``key`` names the column that identifies a review. Without one, rows are
    numbered and stored under ``out``.

    ``train``, ``eval`` (``eval_x`` and ``eval_y`` as CSV), raw ``test`` rows,
    ``dictionary`` and, for ``sample`` above 0, ``train_sample``. Held-out test
    rows never shape the vocabulary; evaluation rows do unless
    ``vocab_from_train_only``.

    With ``learn_abbreviations``, sentences do not end at abbreviations found in the same
    rows; ``predict`` and ``evaluate_raw`` have to be given that table too.
    """
    labelled = keep_labelled(keyed(reviews, key, f"{out}/keyed"), num_classes)
    work, held_out = split_test(labelled, test, seed)
    # Stored by part, so that each part is read once and its small files are
    # packed into full tasks.
    work = work.withColumn("part", part_of(split_key(work), test, evaluation, seed))
    abbreviations = None
    if learn_abbreviations:
        texts = work.where("part = 'train'") if vocab_from_train_only else work
        texts = texts.select(clean_text(F.col("review_body")).alias("text"))
        abbreviations = abbr.learn_abbreviations(texts, path=f"{out}/abbreviations")
    tokens = stage(
        review_tokens(work, stop_words, lemmatizer, abbreviations),
        "tokens",
        f"{out}/tokens",
        partition_by="part",
    )
    fit_rows = tokens.where("part = 'train'") if vocab_from_train_only else tokens
    counts = stage(term_counts(fit_rows), "counts", f"{out}/counts")
    vocab = stage(vocabulary(counts, vocab_size, stored=True), "vocab", f"{out}/vocab")

    encoded = add_label(encode_tokens(tokens, vocab, max_len).drop("tokens"), num_classes)
    train_rows, eval_rows = (
        stage(encoded.where(F.col("part") == name).drop("part"), name, f"{out}/{name}")
        for name in ("train", "eval")
    )
    write_dictionary(vocab, f"{out}/dictionary")
    if fmt == "csv":
        write_encoded(train_rows, f"{out}/train_csv", num_classes, "csv", max_len)
        write_xy_csv(eval_rows, f"{out}/eval_x", f"{out}/eval_y", num_classes, max_len)
    picked = sample_rows(train_rows, sample, seed) if sample > 0 else None
    if picked is not None:
        write_encoded(picked, f"{out}/train_sample", num_classes, fmt, max_len)
    if held_out is not None:
        held_out = stage(held_out, "test", f"{out}/test")
        if fmt == "csv":
            write_raw_reviews(held_out, f"{out}/test_tsv")
    settings = Settings(
        num_classes, max_len, vocab_size, test, evaluation, seed, vocab_from_train_only, [f"{out}/tokens"],
        [f"{out}/abbreviations"] if learn_abbreviations else [],
    )
    settings.write(reviews.sparkSession, out)
    return Prepared(train_rows, eval_rows, held_out, vocab, num_classes, vocab_size, picked, abbreviations)


def train(
    encoded: DataFrame,
    algo: str = "nb",
    num_classes: int = 5,
    vocab_size: int | None = None,
    path: str | None = None,
    **params,
) -> Model:
    """Fit ``nb``, ``lr`` or ``mlp`` on encoded rows and save it under ``path``.

    Pass ``vocab_size`` of the preparation; None takes the largest index seen.
    """
    if algo == "nb":
        model: Model = fit_naive_bayes(encoded, num_classes, vocab_size, **params)
    elif algo == "lr":
        model = fit_logistic_regression(encoded, num_classes, vocab_size, **params)
    elif algo == "mlp":
        model = fit_perceptron(encoded, num_classes, **params)
    else:
        raise ValueError("algo must be nb, lr or mlp")
    if path:
        model.save(path)
    return model


def load_model(spark: SparkSession, path: str, algo: str = "nb") -> Model:
    return load_naive_bayes(spark, path) if algo == "nb" else load_spark_ml(path)


def evaluate(model: Model, encoded: DataFrame, out: str | None = None) -> DataFrame:
    """One row of ``n``, ``accuracy`` and ``log_loss`` over encoded rows."""
    scored = model.predict(encoded)
    if out:
        scored = stage(scored, "predictions")
        row = scored.select(F.size("label_ohe").alias("classes")).first()
        write_predictions(scored, out, "review_id" in scored.columns, row.classes if row else 5)
    return evaluate_predictions(scored)


def evaluate_raw(
    model: Model,
    reviews: DataFrame,
    vocab: DataFrame,
    num_classes: int = 5,
    max_len: int = MAX_LEN,
    out: str | None = None,
    **text_options,
) -> DataFrame:
    """Encode labelled raw reviews with a saved dictionary, then evaluate."""
    encoded, _ = encode_reviews(reviews, num_classes, vocab, max_len, **text_options)
    return evaluate(model, encoded, out)


def predict(
    model: Model,
    reviews: DataFrame,
    vocab: DataFrame,
    num_classes: int = 5,
    max_len: int = MAX_LEN,
    out: str | None = None,
    key: str | None = "review_id",
    **text_options,
) -> DataFrame:
    """Score unlabelled raw reviews, one output row per input row.

    Rows without any known word get a null prediction. Binary predictions are
    named; five-class ones are given as stars.
    """
    reviews = keyed(reviews, key)
    tokens = review_tokens(reviews.select("review_id", "review_body"), **text_options)
    encoded = flag_tokens(tokens, vocab, max_len).drop("tokens")
    known = F.col("known")
    scored = model.predict(encoded).select(
        "review_id",
        F.when(known, F.col("probability")).alias("probability"),
        F.when(known, F.col("prediction")).alias("prediction"),
    )
    if out:
        scored = stage(scored, "predictions")
        write_predictions(scored, out, num_classes=num_classes)
    if num_classes == 2:
        return scored.withColumn("label", class_name(F.col("prediction")))
    return scored.withColumn("stars", stars_of(F.col("prediction")))
