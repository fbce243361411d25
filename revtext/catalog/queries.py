"""Registered queries: each operator over the shared tables."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revtext.catalog.tables import documents, reviews, table, texts
from revtext.functions import arrays, cleaning, labels, tokens
from revtext.functions.lemma import IRREGULAR, VERBS, VerbLemmatizer
from revtext.operators import abbreviations as abbr
from revtext.operators import evaluation as quality
from revtext.operators import (
    frequent,
    lemmas,
    naive_bayes,
    scoring,
    spark_ml,
    splitting,
    training,
    vocabulary,
)
from revtext.operators.metrics import evaluate_predictions
from revtext.plans import encode, incremental, jobs
from revtext.schemas import EVAL_FRACTION, TEST_FRACTION, VOCAB_SIZE
from revtext.sinks import datasets
from revtext.sources.dictionary import read_dictionary
from revtext.sources.encoded import read_encoded_csv, read_xy_csv
from revtext.sources.reviews import read_reviews, read_reviews_rescued
from revtext.storage import Registry, stage, stage_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def _joined(values: Column | str) -> Column:
    return F.array_join(F.transform(values, lambda v: v.cast("string")), " ")


# Projections, filters, nulls


@query
def project_text_label(spark, folder):
    return reviews(spark, folder).select("review_id", "review_body", "star_rating")


@query
def filter_binary(spark, folder):
    return labels.keep_labelled(reviews(spark, folder), 2).select("review_id", "star_rating")


@query
def filter_multi(spark, folder):
    """Ratings of 5, of 0 and without one: only the first lie in the domain."""
    rated = table(spark, folder, "labels").select("doc_id", (F.col("quality") * 5).alias("star_rating"))
    ids = table(spark, folder, "documents").select("doc_id")
    joined = ids.join(rated, "doc_id", "left").withColumnRenamed("doc_id", "review_id")
    return labels.keep_labelled(joined, 5)


@query
def fill_null_rating(spark, folder):
    rated = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("star_rating"))
    ids = table(spark, folder, "documents").select("doc_id")
    joined = ids.join(rated, "doc_id", "left").withColumnRenamed("doc_id", "review_id")
    return joined.fillna(0, ["star_rating"])


# Splits


@query
def split_test(spark, folder):
    work, held_out = splitting.split_test(reviews(spark, folder).select("review_id", "star_rating"))
    return work.withColumn("part", F.lit("work")).unionByName(
        held_out.withColumn("part", F.lit("test"))
    )


@query
def split_train_eval(spark, folder):
    work, _ = splitting.split_test(reviews(spark, folder).select("review_id", "star_rating"))
    train, evaluation = splitting.split_train_eval(work)
    return train.withColumn("part", F.lit("train")).unionByName(
        evaluation.withColumn("part", F.lit("eval"))
    )


@query
def sample_train(spark, folder):
    work, _ = splitting.split_test(reviews(spark, folder).select("review_id", "star_rating"))
    return splitting.sample_rows(splitting.split_train_eval(work)[0], 0.1)


# Cleaning


def _cleaning(name: str, step: Callable[[Column], Column]) -> None:
    def build(spark, folder):
        return texts(spark, folder).select("kind", "id", "part", step(F.col("text")).alias("text"))

    QUERIES[name] = build


@query
def clean_null(spark, folder):
    """All texts and a null one."""
    docs = documents(spark, folder)
    null = spark.range(1).select(F.lit(-1).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    return docs.unionByName(null).select(
        F.col("doc_id").alias("review_id"), cleaning.fill_null(F.col("text")).alias("review_body")
    )


_cleaning("clean_markup", cleaning.remove_markup)

@query
def clean_http(spark, folder):
    """All texts, and the addresses of pages, which all hold a link."""
    urls = table(spark, folder, "pages").select(
        F.lit("url").alias("kind"),
        F.col("page_id").alias("id"),
        F.lit(0).cast("long").alias("part"),
        F.concat(F.lit("see "), F.col("url"), F.lit(" there")).alias("text"),
    )
    both = texts(spark, folder).unionByName(urls)
    return both.select("kind", "id", "part", cleaning.remove_http(F.col("text")).alias("text"))


@query
def clean_entities(spark, folder):
    """All texts with their quotation marks written as entities."""
    coded = F.replace("text", F.lit('"'), F.lit("&#34;"))
    return texts(spark, folder).select("kind", "id", "part", cleaning.remove_entities(coded).alias("text"))


_cleaning("clean_www", cleaning.remove_www)
_cleaning("clean_email", cleaning.remove_emails)
_cleaning("clean_lower", F.lower)
_cleaning("clean_text", cleaning.clean_text)


# Tokens


def _tokens_of_texts(name: str, step: Callable[[Column], Column]) -> None:
    def build(spark, folder):
        words = step(cleaning.clean_text(F.col("text")))
        split = texts(spark, folder).select("kind", "id", "part", words.alias("words"))
        return split.select(
            "kind",
            "id",
            "part",
            F.size("words").alias("n"),
            F.array_join("words", " ").alias("tokens"),
        )

    QUERIES[name] = build


def _stopped(text: Column) -> Column:
    return tokens.remove_stop_words(tokens.tokenize(text))


def _stripped(text: Column) -> Column:
    return tokens.strip_punctuation(_stopped(text))


def _dropped(text: Column) -> Column:
    return tokens.drop_empty_tokens(_stripped(text))


_tokens_of_texts("tokenize", tokens.tokenize)
_tokens_of_texts("stop_words", _stopped)
_tokens_of_texts("strip_punct", _stripped)
_tokens_of_texts("drop_empty_tokens", _dropped)
_tokens_of_texts("lemmatize", lambda text: VerbLemmatizer().lemmas(_dropped(text)))


def _clean_texts(spark: SparkSession, folder: str) -> DataFrame:
    text = cleaning.clean_text(F.col("text"))
    return stage(texts(spark, folder).select("kind", "id", "part", text.alias("text")), "clean")


@query
def abbreviations(spark, folder):
    """Every word seen with a final period, with its score."""
    scored = abbr.learn_abbreviations(_clean_texts(spark, folder), least=None)
    # Zero has one sign.
    return scored.select("word", "n_final", "n_plain", (F.round("score", 6) + 0.0).alias("score"))


@query
def tokenize_learned(spark, folder):
    """All texts; the abbreviations found in them keep their period."""
    clean = _clean_texts(spark, folder)
    split = abbr.tokenize_learned(clean, abbr.learn_abbreviations(clean), F.col("text"), "words")
    return split.select(
        "kind", "id", "part", F.size("words").alias("n"), F.array_join("words", " ").alias("tokens")
    )


@query
def lemmatize_table(spark, folder):
    """The same as ``lemmatize``, with lexicon and exceptions as tables."""
    words = _dropped(cleaning.clean_text(F.col("text")))
    # No word is empty or holds a blank; one string is stored in half the time of an array.
    split = texts(spark, folder).select("kind", "id", "part", F.array_join(words, " ").alias("words"))
    stored = stage(split, "words", codec="zstd")
    words = F.when(F.col("words") == "", F.array().cast("array<string>")).otherwise(F.split("words", " "))
    lexicon = spark.createDataFrame([(v,) for v in VERBS], "lemma string")
    listed = [(form, i, lemma) for form, found in IRREGULAR.items() for i, lemma in enumerate(found, 1)]
    exceptions = spark.createDataFrame(listed, "form string, ord int, lemma string")
    done = lemmas.lemmatize_table(stored.withColumn("words", words), lexicon, exceptions, "words")
    return done.select("kind", "id", "part", F.size("words").alias("n"), F.array_join("words", " ").alias("tokens"))


# Vocabulary and encoding


def _review_tokens(spark: SparkSession, folder: str, num_classes: int = 5) -> DataFrame:
    return encode.review_tokens(labels.keep_labelled(reviews(spark, folder), num_classes))


def _tokens_and_vocab(spark, folder, num_classes=5) -> tuple[DataFrame, DataFrame]:
    stored = stage(_review_tokens(spark, folder, num_classes), "tokens")
    return stored, encode.build_vocabulary(stored)


@query
def term_count(spark, folder):
    return vocabulary.term_counts(_review_tokens(spark, folder))


@query
def vocab_topk(spark, folder):
    return vocabulary.vocabulary(vocabulary.term_counts(_review_tokens(spark, folder)))


@query
def vocab_two_pass(spark, folder):
    """The vocabulary from a sketch and the exact counts of its candidates."""
    stored = stage(_review_tokens(spark, folder), "tokens")
    return vocabulary.vocabulary(frequent.frequent_counts(stored))


@query
def vocab_large(spark, folder):
    """A vocabulary of 50,000 words."""
    return vocabulary.vocabulary(vocabulary.term_counts(_review_tokens(spark, folder)), 50_000)


@query
def token_index(spark, folder):
    indexed = vocabulary.index_tokens(*_tokens_and_vocab(spark, folder))
    return indexed.select("review_id", _joined("idx").alias("idx"))


@query
def token_index_join(spark, folder):
    """The same with all but 1,000 words joined, as larger dictionaries are."""
    indexed = vocabulary.index_by_join(*_tokens_and_vocab(spark, folder), head=1000)
    return indexed.select("review_id", _joined("idx").alias("idx"))


@query
def drop_empty(spark, folder):
    stored, vocab = _tokens_and_vocab(spark, folder, 5)
    return vocabulary.encode_tokens(stored, vocab).select("review_id", "star_rating")


@query
def pad_trim(spark, folder):
    indexed = vocabulary.index_tokens(*_tokens_and_vocab(spark, folder))
    return indexed.select("review_id", _joined(arrays.pad_trim(F.col("idx"))).alias("features"))


@query
def index_sum(spark, folder):
    indexed = vocabulary.index_tokens(*_tokens_and_vocab(spark, folder))
    return indexed.select("review_id", arrays.index_sum(F.col("idx")).alias("total"))


@query
def normalize_idx(spark, folder):
    indexed = vocabulary.index_tokens(*_tokens_and_vocab(spark, folder))
    scaled = indexed.select("review_id", arrays.normalize(F.col("idx")).alias("scaled"))
    # Millionths as whole numbers, so that engines print them alike.
    millionths = F.transform("scaled", lambda v: F.round(v.cast("double") * 1e6).cast("long"))
    return scaled.select("review_id", _joined(millionths).alias("millionths"))


def _encoded_text(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "review_id",
        "star_rating",
        _joined("features").alias("features"),
        _joined("label_ohe").alias("label_ohe"),
    )


@query
def encode_binary(spark, folder):
    return _encoded_text(encode.encode_reviews(reviews(spark, folder), 2)[0])


@query
def encode_multi(spark, folder):
    return _encoded_text(encode.encode_reviews(reviews(spark, folder), 5)[0])


# Labels and rows


def _one_hot(num_classes: int) -> Query:
    def build(spark, folder):
        labelled = labels.keep_labelled(reviews(spark, folder), num_classes)
        label = labels.one_hot(F.col("star_rating"), num_classes)
        return labelled.select("review_id", _joined(label).alias("label_ohe"))

    return build


QUERIES["one_hot_multi"] = _one_hot(5)
QUERIES["one_hot_binary"] = _one_hot(2)


def _flat(spark, folder) -> DataFrame:
    encoded, _ = encode.encode_reviews(reviews(spark, folder), 2)
    row = arrays.flat_row(F.col("features"), F.col("label_ohe"))
    return encoded.select("review_id", row.alias("row"))


@query
def features_flat(spark, folder):
    return _flat(spark, folder).select("review_id", _joined("row").alias("row"))


@query
def split_xy(spark, folder):
    flat = _flat(spark, folder).select(
        "review_id",
        arrays.split_features(F.col("row"), 2).alias("x"),
        arrays.split_labels(F.col("row"), 2).alias("y"),
    )
    whole = F.transform("x", lambda v: v.cast("int"))
    return flat.select("review_id", _joined(whole).alias("x"), _joined("y").alias("y"))


# Models


def _parts(spark, folder, num_classes=2) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Encoded training and evaluation rows, vocabulary, raw test rows."""
    labelled = labels.keep_labelled(reviews(spark, folder), num_classes)
    work, held_out = splitting.split_test(labelled)
    encoded, vocab = encode.encode_reviews(work, num_classes)
    encoded = stage(encoded, "encoded")
    train, evaluation = splitting.split_train_eval(encoded, TEST_FRACTION, EVAL_FRACTION)
    return train, evaluation, vocab, held_out


def _bayes(spark, folder, num_classes=2):
    train, evaluation, vocab, held_out = _parts(spark, folder, num_classes)
    return naive_bayes.fit_naive_bayes(train, num_classes), evaluation, vocab, held_out


def _rounded(values: str, names: str, count: int) -> list[Column]:
    return [F.round(F.get(values, F.lit(i)), 6).alias(f"{names}{i}") for i in range(count)]


@query
def nb_prior(spark, folder):
    prior = _bayes(spark, folder)[0].prior
    return prior.select("class", "n", F.round("log_prior", 6).alias("log_prior"))


@query
def nb_word_loglik(spark, folder):
    words = _bayes(spark, folder)[0].words
    return words.select("class", "idx", "n", F.round("loglik", 6).alias("loglik"))


@query
def nb_score(spark, folder):
    model, evaluation, _, _ = _bayes(spark, folder)
    return model.scores(evaluation).select("review_id", *_rounded("scores", "score", 2))


@query
def nb_score_join(spark, folder):
    """The same with all but 1,000 words joined, as larger vocabularies are."""
    model, evaluation, _, _ = _bayes(spark, folder)
    return model.scores_by_join(evaluation, 1000).select("review_id", *_rounded("scores", "score", 2))


@query
def class_probability(spark, folder):
    model, evaluation, _, _ = _bayes(spark, folder)
    return model.predict(evaluation).select("review_id", *_rounded("probability", "p", 2))


@query
def argmax_class(spark, folder):
    model, evaluation, _, _ = _bayes(spark, folder)
    label = labels.class_of(F.col("label_ohe"))
    scored = model.predict(evaluation)
    return scored.select(
        "review_id",
        "prediction",
        label.alias("label"),
        labels.class_name(F.col("prediction")).alias("name"),
    )


@query
def stars(spark, folder):
    model, evaluation, _, _ = _bayes(spark, folder, 5)
    scored = model.predict(evaluation)
    return scored.select(
        "review_id", "star_rating", labels.stars_of(F.col("prediction")).alias("stars")
    )


def _metrics(scored: DataFrame, *names: str) -> DataFrame:
    return _rounded_metrics(evaluate_predictions(scored), *names)


def _rounded_metrics(metrics: DataFrame, *names: str) -> DataFrame:
    return metrics.select("n", *[F.round(name, 6).alias(name) for name in names])


@query
def accuracy_eval(spark, folder):
    model, evaluation, _, _ = _bayes(spark, folder)
    return _metrics(model.predict(evaluation), "accuracy")


@query
def accuracy_train(spark, folder):
    """Accuracy over a sample of the training rows."""
    train, _, _, _ = _parts(spark, folder)
    model = naive_bayes.fit_naive_bayes(train, 2)
    return _metrics(model.predict(splitting.sample_rows(train, 0.2)), "accuracy")


@query
def log_loss(spark, folder):
    model, evaluation, _, _ = _bayes(spark, folder)
    return _metrics(model.predict(evaluation), "log_loss")


@query
def accuracy(spark, folder):
    """Accuracy over held-out raw reviews, encoded with the saved vocabulary."""
    model, _, vocab, held_out = _bayes(spark, folder)
    metrics = jobs.evaluate_raw(model, held_out, vocab, 2)
    return metrics.select("n", F.round("accuracy", 6).alias("accuracy"))


def _rounded_scores(spark, folder) -> DataFrame:
    """Scores of evaluation rows for five classes; rounded, so that engines agree on ties."""
    model, evaluation, _, _ = _bayes(spark, folder, 5)
    each = quality.class_scores(model.predict(evaluation))
    return stage(each.withColumn("score", F.round("score", 6)), "class-scores")


@query
def auc_eval(spark, folder):
    found = quality.auc(_rounded_scores(spark, folder))
    return found.select("class", "positives", "negatives", F.round("auc", 9).alias("auc"))


@query
def confusion(spark, folder):
    model, evaluation, _, _ = _bayes(spark, folder, 5)
    cells = quality.confusion(model.predict(evaluation), 5)
    return cells.select("label", "prediction", "n", F.round("share", 6).alias("share"))


@query
def calibration(spark, folder):
    bins = quality.calibration(_rounded_scores(spark, folder))
    errors = quality.calibration_error(bins).select("class", F.round("error", 6).alias("error"))
    rounded = [F.round(c, 6).alias(c) for c in ("mean_score", "observed")]
    return bins.join(errors, "class").select("class", "bin", "n", *rounded, "error")


@query
def score_batch_udf(spark, folder):
    model, evaluation, _, _ = _bayes(spark, folder)
    weights = np.array(model.weights())
    prior = np.array([r.log_prior for r in model.prior.orderBy("class").collect()])

    def make_predict_fn():
        def predict(features: np.ndarray) -> np.ndarray:
            scores = prior + weights[:, features.astype(int)].sum(axis=2).T
            odds = np.exp(scores - scores.max(axis=1, keepdims=True))
            return odds / odds.sum(axis=1, keepdims=True)

        return predict

    scored = scoring.score_batches(evaluation, make_predict_fn)
    return scored.select("review_id", *_rounded("probability", "p", 2), "prediction")


def _well_formed(scored: DataFrame) -> DataFrame:
    total = F.aggregate("probability", F.lit(0.0), lambda a, p: a + p)
    first = F.array_position("probability", F.array_max("probability")) - 1
    return scored.withColumn("sums_to_one", F.abs(total - 1) < 1e-9).withColumn(
        "first_largest", F.col("prediction") == first
    )


def _mean_is_share(model: spark_ml.SparkMLModel, train: DataFrame) -> DataFrame:
    """With a free intercept, mean probabilities over the training rows are the classes' shares."""
    scored = stage(model.predict(train), "scored")
    means = scored.agg(F.avg(F.get("probability", F.lit(0))).alias("m0"), F.avg(F.get("probability", F.lit(1))).alias("m1"))
    label = labels.class_of(F.col("label_ohe"))
    per_class = scored.groupBy(label.alias("class")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    mean = F.when(F.col("class") == 0, F.col("m0")).otherwise(F.col("m1"))
    near = F.abs(mean - F.col("n") / total) < 1e-3
    return per_class.crossJoin(F.broadcast(means)).select("class", "n", near.alias("mean_is_share"))


@query
def train_lr(spark, folder):
    train, _, _, _ = _parts(spark, folder)
    return _mean_is_share(spark_ml.fit_logistic_regression(train, 2, VOCAB_SIZE, num_partitions=1), train)


@query
def train_trigrams(spark, folder):
    """The same with runs of three words besides."""
    train, _, _, _ = _parts(spark, folder)
    model = spark_ml.fit_logistic_regression(train, 2, VOCAB_SIZE, num_partitions=1, trigram_cells=1 << 16)
    return _mean_is_share(model, train)


@query
def train_history(spark, folder):
    """A row per slice: rows it was evaluated on, whether it lowered the training loss, and whether one slice is best."""
    train, evaluation, _, _ = _parts(spark, folder)
    evaluation = stage(evaluation, "evaluation")
    made = training.train_in_slices(
        train, evaluation, stage_path(spark, "slices"), 2, slices=3, steps=5, patience=3, hidden=(16,),
        embedding=32, num_partitions=1,
    )
    every = Window.partitionBy()  # a row per slice
    before = F.lag("train_loss").over(Window.orderBy("slice"))
    least = F.min(F.struct("loss", "slice")).over(every)["slice"]
    rows = made.history.withColumns({"before": before, "least": least, "bests": F.sum(F.col("best").cast("int")).over(every)})
    n = evaluation.agg(F.count(F.lit(1)).alias("n"))
    falls = (F.col("before").isNull() | (F.col("train_loss") < F.col("before"))).alias("loss_falls")
    best = ((F.col("best") == (F.col("slice") == F.col("least"))) & (F.col("bests") == 1)).alias("best_chosen")
    return rows.crossJoin(F.broadcast(n)).select("slice", "n", falls, best)

@query
def score_lr(spark, folder):
    train, evaluation, _, _ = _parts(spark, folder)
    model = spark_ml.fit_logistic_regression(train, 2, VOCAB_SIZE, max_iter=30, num_partitions=1)
    return _well_formed(model.predict(evaluation)).select("review_id", "sums_to_one", "first_largest")


@query
def train_mlp(spark, folder):
    """Rows scored, whether all are well formed, and whether the fit beats a guess."""
    train, evaluation, _, _ = _parts(spark, folder)
    model = spark_ml.fit_perceptron(train, 2, max_iter=20, num_partitions=8)
    fitted = evaluate_predictions(model.predict(train)).select((F.col("log_loss") < math.log(2)).alias("beats_guess"))
    formed = _well_formed(model.predict(evaluation)).agg(
        F.count(F.lit(1)).alias("n"), F.every(F.col("sums_to_one") & F.col("first_largest")).alias("well_formed")
    )
    return formed.crossJoin(F.broadcast(fitted))


# Sources and sinks, as round trips through files


def _single_line(spark, folder) -> DataFrame:
    body = F.regexp_replace("review_body", r"[\t\r\n]", " ")
    return reviews(spark, folder).withColumn("review_body", body)


@query
def src_reviews_tsv(spark, folder):
    path = stage_path(spark, "reviews-tsv")
    datasets.write_raw_reviews(_single_line(spark, folder), path, quote="")
    return read_reviews(spark, path).select(
        F.col("review_id").cast("long").alias("review_id"), "review_body", "star_rating"
    )


@query
def src_reviews_rescued(spark, folder):
    """Review lines, some with a field too many, cut short, or with a rating in words."""
    path, key = stage_path(spark, "damaged-tsv"), F.col("review_id").cast("string")
    star, body = F.col("star_rating").cast("string"), F.col("review_body")
    damage = splitting.point(F.col("review_id"), use="damage") % 10
    line = (
        F.when(damage == 0, F.concat_ws("\t", key, star, body, F.lit("more")))
        .when(damage == 1, F.concat_ws("\t", key, star))
        .when(damage == 2, F.concat_ws("\t", key, F.lit("five"), body))
        .otherwise(F.concat_ws("\t", key, star, body))
    )
    # A column of whole lines under the header line, in every file.
    lines = _single_line(spark, folder).select(line.alias("review_id\tstar_rating\treview_body"))
    plain = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    lines.write.csv(path, header=True, sep="\x01", quote="", escape="", **plain)
    read = read_reviews_rescued(spark, path)
    return read.select(F.col("review_id").cast("long").alias("review_id"), "star_rating", "review_body", F.col("_rescued").alias("rescued"))


@query
def snk_test_tsv(spark, folder):
    path = stage_path(spark, "test-tsv")
    _, held_out = splitting.split_test(reviews(spark, folder))
    datasets.write_raw_reviews(held_out, path)
    return read_reviews(spark, path, quote='"', multiline=True).select(
        F.col("review_id").cast("long").alias("review_id"), "review_body", "star_rating"
    )


@query
def snk_train_csv(spark, folder):
    path = stage_path(spark, "train-csv")
    datasets.write_encoded(_parts(spark, folder)[0], path, 2, "csv")
    return spark.read.text(path).select(F.col("value").alias("line"))


def _xy_text(encoded: DataFrame, *key: str) -> DataFrame:
    return encoded.select(
        *key, _joined("features").alias("features"), _joined("label_ohe").alias("label_ohe")
    )


@query
def src_train_csv(spark, folder):
    path = stage_path(spark, "train-csv")
    datasets.write_encoded(_parts(spark, folder, 5)[0], path, 5, "csv")
    return _xy_text(read_encoded_csv(spark, path, 5))


@query
def src_one_file(spark, folder):
    path = stage_path(spark, "one-file")
    datasets.write_encoded(_parts(spark, folder)[1], path, 2, "csv")
    flat = read_encoded_csv(spark, path, 2).select(
        arrays.flat_row(F.col("features"), F.col("label_ohe")).alias("row")
    )
    x = F.transform(arrays.split_features(F.col("row"), 2), lambda v: v.cast("int"))
    y = arrays.split_labels(F.col("row"), 2)
    return flat.select(_joined(x).alias("features"), _joined(y).alias("label_ohe"))


def _xy_files(spark, folder, keyed: bool) -> DataFrame:
    x, y = stage_path(spark, "eval-x"), stage_path(spark, "eval-y")
    evaluation = stage(_parts(spark, folder)[1], "eval")
    datasets.write_xy_csv(evaluation, x, y, 2, keyed=keyed)
    return read_xy_csv(spark, x, y, 2, keyed=keyed)


@query
def snk_eval_xy(spark, folder):
    return _xy_text(_xy_files(spark, folder, keyed=True), "review_id")


@query
def src_xy_files(spark, folder):
    return _xy_text(_xy_files(spark, folder, keyed=False))


@query
def snk_train_sample(spark, folder):
    path = stage_path(spark, "train-sample")
    sample = splitting.sample_rows(_parts(spark, folder, 5)[0], 0.2)
    datasets.write_encoded(sample, path, 5, "csv")
    return spark.read.text(path).select(F.col("value").alias("line"))


@query
def snk_dictionary(spark, folder):
    path = stage_path(spark, "dictionary")
    datasets.write_dictionary(_tokens_and_vocab(spark, folder, 2)[1], path)
    entry = F.concat(F.lit("{"), F.btrim("value", F.lit("{},")), F.lit("}"))
    return spark.read.text(path).select(F.explode(F.from_json(entry, "map<string,int>")).alias("token", "idx"))


@query
def src_dictionary(spark, folder):
    path = stage_path(spark, "dictionary")
    datasets.write_dictionary(_tokens_and_vocab(spark, folder)[1], path)
    return read_dictionary(spark, path)


@query
def snk_predictions(spark, folder):
    path = stage_path(spark, "predictions")
    model, evaluation, _, _ = _bayes(spark, folder, 5)
    datasets.write_predictions(model.predict(evaluation), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query
def snk_predictions_binary(spark, folder):
    path = stage_path(spark, "predictions")
    model, evaluation, _, _ = _bayes(spark, folder, 2)
    datasets.write_predictions(model.predict(evaluation), path, num_classes=2)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query
def snk_model(spark, folder):
    path = stage_path(spark, "model")
    _bayes(spark, folder)[0].save(path)
    prior = spark.read.parquet(f"{path}/prior")
    words = spark.read.parquet(f"{path}/words")
    rows = prior.select("class", F.lit(0).alias("idx"), "n", F.round("log_prior", 6).alias("value"))
    return rows.union(words.select("class", "idx", "n", F.round("loglik", 6)))


@query
def src_model(spark, folder):
    path = stage_path(spark, "model")
    model, evaluation, _, _ = _bayes(spark, folder)
    model.save(path)
    loaded = jobs.load_model(spark, path)
    return loaded.predict(evaluation).select(
        "review_id", *_rounded("probability", "p", 2), "prediction"
    )


# Jobs


@query
def job_prepare(spark, folder):
    """Every line of every data set of one preparation run."""
    out = stage_path(spark, "prepare")
    jobs.prepare(reviews(spark, folder), out, 2, sample=0.2, fmt="csv")

    def lines(dataset: str, rows: DataFrame, line: Column | str = "value") -> DataFrame:
        line = F.col(line) if isinstance(line, str) else line
        return rows.select(F.lit(dataset).alias("dataset"), line.cast("string").alias("line"))

    files = [
        lines(name, spark.read.text(f"{out}/{path}"))
        for name, path in (
            ("train", "train_csv"), ("eval_x", "eval_x"), ("eval_y", "eval_y"), ("sample", "train_sample"),
        )
    ]
    test = read_reviews(spark, f"{out}/test_tsv", quote='"', multiline=True)
    words = read_dictionary(spark, f"{out}/dictionary")
    found = [
        *files,
        lines("test", test, F.concat_ws(",", "review_id", F.md5(F.col("review_body").cast("binary")))),
        lines("dictionary", words, F.concat_ws(",", F.col("idx").cast("string"), "token")),
    ]
    return reduce(DataFrame.unionByName, found)


@query
def prepare_incremental(spark, folder):
    """A preparation of most reviews, then of the others on top: the data sets of all of them."""
    every = reviews(spark, folder)
    late = splitting.point(F.col("review_id"), use="late") < splitting.POINTS // 5
    before, out = stage_path(spark, "prepare-old"), stage_path(spark, "prepare-new")
    jobs.prepare(every.where(~late), before, 2)
    made = incremental.prepare_incremental(spark, before, every.where(late), out)

    def rows(dataset: str, table: DataFrame, *columns: Column | str) -> DataFrame:
        return table.select(F.lit(dataset).alias("dataset"), F.concat_ws(",", *columns).alias("line"))

    key, features = F.col("review_id").cast("string"), F.array_join(F.transform("features", lambda i: i.cast("string")), ",")
    found = [
        rows("train", made.train, key, features),
        rows("eval", made.evaluation, key, features),
        rows("test", made.test, key, F.md5(F.col("review_body").cast("binary"))),
        rows("dictionary", read_dictionary(spark, f"{out}/dictionary"), F.col("idx").cast("string"), "token"),
    ]
    return reduce(DataFrame.unionByName, found)


@query
def job_reuse(spark, folder):
    """A token table asked for twice, then with another parameter: the second time it is not made again."""
    registry = Registry(spark, stage_path(spark, "registry"))
    inputs = [f"{folder}/{name}.parquet" for name in ("documents", "labels")]
    found = []
    for run, classes in ((1, 2), (2, 2), (3, 5)):
        made, reused = registry.table("tokens", lambda c=classes: _review_tokens(spark, folder, c), inputs, classes=classes)
        words = F.coalesce(F.sum(F.size("tokens").cast("long")), F.lit(0))
        flags = (F.lit(run).alias("run"), F.lit(reused).alias("reused"))
        found.append(made.agg(F.count(F.lit(1)).alias("rows"), words.alias("words")).select(*flags, "rows", "words"))
    return reduce(DataFrame.unionByName, found)


@query
def job_all(spark, folder):
    """Preparation, training and evaluation one after the other."""
    made = jobs.prepare(reviews(spark, folder), stage_path(spark, "job-all"), 2)
    model = jobs.train(made.train, "nb", 2, made.vocab_size)
    return _rounded_metrics(jobs.evaluate(model, made.evaluation), "accuracy", "log_loss")


@query
def job_predict(spark, folder):
    """Stars of all documents as unlabelled reviews; null without known words."""
    model, _, vocab, _ = _bayes(spark, folder, 5)
    unlabelled = documents(spark, folder).toDF("review_id", "review_body")
    return jobs.predict(model, unlabelled, vocab).select("review_id", "stars")
