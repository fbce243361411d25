"""Vocabulary, encoding, splits, labels and models on small fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from revtext.functions import arrays, labels
from revtext.functions.lemma import VerbLemmatizer
from revtext.operators import naive_bayes, scoring, splitting, vocabulary
from revtext.operators.metrics import evaluate_predictions
from revtext.plans.encode import encode_reviews, review_tokens
from revtext.plans.jobs import train

TOKEN_ROWS = "review_id long, tokens array<string>"


def rows(df, *columns):
    return sorted(tuple(row[c] for c in columns) for row in df.collect())


def test_vocabulary_is_the_same_at_any_partitioning(spark):
    data = [(i, [w]) for i, w in enumerate("b a c b a d c e f g".split())]
    expected = [("a", 2, 1), ("b", 2, 2), ("c", 2, 3), ("d", 1, 4)]
    for parts in (1, 2, 5):
        df = spark.createDataFrame(data, TOKEN_ROWS).repartition(parts)
        vocab = vocabulary.vocabulary(vocabulary.term_counts(df), 4)
        assert rows(vocab, "token", "n", "idx") == expected


def test_null_and_empty_token_lists_count_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, ["x", "x"])], TOKEN_ROWS)
    assert rows(vocabulary.term_counts(df), "token", "n") == [("x", 2)]


VOCAB = [("good", 9, 1), ("bad", 5, 2)]


def encoded_by(spark, data, length=4, limit=None, monkeypatch=None):
    if limit is not None:
        monkeypatch.setattr(vocabulary, "MAX_ENTRIES", limit)
    vocab = spark.createDataFrame(VOCAB, "token string, n long, idx int")
    df = spark.createDataFrame(data, TOKEN_ROWS)
    return (
        rows(vocabulary.encode_tokens(df, vocab, length), "review_id", "features"),
        rows(vocabulary.index_tokens(df, vocab), "review_id", "idx"),
    )


@pytest.mark.parametrize("limit", [None, 1])
def test_encoding_edges(spark, monkeypatch, limit):
    data = [
        (1, ["good", "odd", "bad"]),
        (2, ["odd"]),
        (3, []),
        (4, ["odd"] * 4 + ["good"]),
        (5, ["bad"] * 4),
        (6, ["bad"] * 5),
    ]
    encoded, indexed = encoded_by(spark, data, 4, limit, monkeypatch)
    assert encoded == [
        (1, [1, 0, 2, 0]),
        (4, [0, 0, 0, 0]),
        (5, [2, 2, 2, 2]),
        (6, [2, 2, 2, 2]),
    ]
    assert indexed == [
        (1, [1, 0, 2]),
        (2, [0]),
        (3, []),
        (4, [0, 0, 0, 0, 1]),
        (5, [2] * 4),
        (6, [2] * 5),
    ]


def test_hot_word_is_spread_over_salts(spark):
    df = spark.createDataFrame([(i, ["hot"] * 50) for i in range(40)], TOKEN_ROWS)
    vocab = spark.createDataFrame([("hot", 2000, 1)], "token string, n long, idx int")
    indexed = vocabulary.index_by_join(df, vocab, head=0)
    assert rows(indexed, "review_id", "idx") == [(i, [1] * 50) for i in range(40)]


def test_padding_lengths(spark):
    df = spark.createDataFrame([(n, [7] * n) for n in (0, 99, 100, 101)], "n int, idx array<int>")
    got = df.select("n", arrays.pad_trim(F.col("idx")).alias("f")).collect()
    assert [row.f for row in got] == [[7] * min(n, 100) + [0] * (100 - min(n, 100)) for n in (0, 99, 100, 101)]


def test_array_functions(spark):
    df = spark.createDataFrame([([3, 0, 10000], [0, 1])], "idx array<int>, label array<int>")
    flat = arrays.flat_row(F.col("idx"), F.col("label"))
    row = df.select(
        arrays.index_sum(F.col("idx")).alias("total"),
        arrays.normalize(F.col("idx")).alias("scaled"),
        arrays.split_features(flat, 2).alias("x"),
        arrays.split_labels(flat, 2).alias("y"),
    )
    assert row.schema["x"].dataType.simpleString() == "array<float>"
    got = row.first()
    assert got.total == 10003
    assert got.scaled == (np.array([3, 0, 10000], dtype=np.float32) / 10000).tolist()
    assert got.x == [3.0, 0.0, 10000.0] and got.y == [0, 1]


def test_label_domains(spark):
    stars = [0, 1, 2, 3, 4, 5, 6, None]
    df = spark.createDataFrame([(s,) for s in stars], "star_rating int")
    binary = labels.keep_labelled(df, 2).select("star_rating", labels.one_hot(F.col("star_rating"), 2).alias("l"))
    assert rows(binary, "star_rating", "l") == [(1, [1, 0]), (2, [1, 0]), (4, [0, 1]), (5, [0, 1])]
    multi = labels.keep_labelled(df, 5).select("star_rating", labels.one_hot(F.col("star_rating"), 5).alias("l"))
    assert rows(multi, "star_rating", "l") == [(s, [int(i == s) for i in range(1, 6)]) for s in range(1, 6)]
    with pytest.raises(ValueError):
        labels.keep_labelled(df, 3)


def test_argmax_takes_the_first_of_ties(spark):
    df = spark.createDataFrame([([0.2, 0.5, 0.5],), ([0.5, 0.5],)], "p array<double>")
    assert [r.c for r in df.select(labels.class_of(F.col("p")).alias("c")).collect()] == [1, 0]


def test_splits_are_disjoint_complete_and_stable(spark):
    def parts(n):
        df = spark.range(5000).withColumnRenamed("id", "review_id").repartition(n)
        work, test = splitting.split_test(df)
        fit, evaluation = splitting.split_train_eval(work)
        return [{r.review_id for r in part.collect()} for part in (fit, evaluation, test)]

    one, many = parts(1), parts(7)
    assert one == many
    assert sum(map(len, one)) == 5000 and len(set().union(*one)) == 5000
    assert 4350 < len(one[0]) < 4650 and 180 < len(one[1]) < 320 and 180 < len(one[2]) < 320
    df = spark.range(10)
    assert splitting.split_test(df, None) == (df, None)


def test_sample_is_independent_of_the_split(spark):
    df = spark.range(20000).withColumnRenamed("id", "review_id")
    fit, _ = splitting.split_train_eval(splitting.split_test(df)[0])
    share = splitting.sample_rows(fit, 0.3).count() / fit.count()
    assert 0.28 < share < 0.32
    assert splitting.sample_rows(fit, 0.0).count() == 0
    assert splitting.sample_rows(fit, 1.0).count() == fit.count()


def test_random_splits(spark):
    df = spark.range(4000).withColumnRenamed("id", "review_id")
    work, test = splitting.split_test(df, 0.1, hashed=False)
    fit, evaluation = splitting.split_train_eval(work, 0.1, 0.2, hashed=False)
    sizes = [part.count() for part in (fit, evaluation, test)]
    assert sum(sizes) == 4000 and 300 < sizes[2] < 500 and 650 < sizes[1] < 950
    assert 0 < splitting.sample_rows(df, 0.1, hashed=False).count() < 800


def labelled_rows(spark, n=60):
    rng = np.random.default_rng(3)
    data = []
    for i in range(n):
        positive = int(rng.random() < 0.7)
        words = rng.integers(1, 6, 5) if positive else rng.integers(4, 9, 5)
        data.append((i, [int(w) for w in words] + [0, 0], [1 - positive, positive]))
    schema = "review_id long, features array<int>, label_ohe array<int>"
    return data, spark.createDataFrame(data, schema)


def test_naive_bayes_against_loops(spark):
    data, df = labelled_rows(spark)
    model = naive_bayes.fit_naive_bayes(df, 2, vocab_size=10)
    by_class = [[f for _, f, label in data if label[c]] for c in (0, 1)]
    expected = {}
    for row_id, features, _ in data:
        scores = []
        for c in (0, 1):
            words = [w for f in by_class[c] for w in f if w]
            score = math.log(len(by_class[c]) + 1) - math.log(len(data) + 2)
            for w in features:
                if w:
                    score += math.log(words.count(w) + 1) - math.log(len(words) + 10)
            scores.append(score)
        expected[row_id] = scores
    for scored in (model.scores(df), model.scores_by_join(df, 3)):
        for row in scored.collect():
            assert row.scores == pytest.approx(expected[row.review_id], abs=1e-9)
    for row in model.predict(df).collect():
        odds = np.exp(expected[row.review_id])
        assert row.probability == pytest.approx(list(odds / odds.sum()), abs=1e-9)
        assert row.prediction == int(np.argmax(odds))


def test_naive_bayes_agrees_with_spark_ml(spark):
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.linalg import Vectors

    data, df = labelled_rows(spark)
    vectors = [
        (float(label[1]), Vectors.dense([features.count(w) for w in range(1, 11)]))
        for _, features, label in data
    ]
    theirs = NaiveBayes().fit(spark.createDataFrame(vectors, ["label", "features"]))
    ours = naive_bayes.fit_naive_bayes(df, 2, vocab_size=10)
    got = np.array([row[1:] for row in ours.weights()])
    assert got == pytest.approx(theirs.theta.toArray(), abs=1e-12)


def test_naive_bayes_keeps_absent_classes(spark):
    _, df = labelled_rows(spark, 20)
    df = df.withColumn("label_ohe", F.concat("label_ohe", F.array([F.lit(0)] * 3)))
    model = naive_bayes.fit_naive_bayes(df, 5, vocab_size=10)
    assert model.prior.count() == 5 and model.words.count() == 50
    assert all(len(r.probability) == 5 for r in model.predict(df).collect())


def test_metrics(spark):
    data = [([0.8, 0.2], [1, 0], 0), ([0.4, 0.6], [1, 0], 1), ([0.0, 1.0], [0, 1], 1)]
    df = spark.createDataFrame(data, "probability array<double>, label_ohe array<int>, prediction int")
    row = evaluate_predictions(df).first()
    assert row.n == 3 and row.accuracy == pytest.approx(2 / 3)
    expected = -(math.log(0.8) + math.log(0.4) + math.log(1 - 1e-7)) / 3
    assert row.log_loss == pytest.approx(expected, rel=1e-9)


def test_batch_scoring_calls_the_model_with_whole_batches(spark):
    _, df = labelled_rows(spark)

    def make():
        def model(features):
            share = (features > 5).mean(axis=1)
            return np.stack([share, 1 - share], axis=1)

        return model

    scored = scoring.score_batches(df, make, length=7, batch_size=16)
    for row in scored.collect():
        share = np.mean(np.array(row.features) > 5)
        assert row.probability == pytest.approx([share, 1 - share])
        assert row.prediction == int(1 - share > share)


@pytest.mark.parametrize("algo,params", [("lr", {"max_iter": 20}), ("mlp", {"max_iter": 15})])
def test_spark_ml_models_learn_and_reload(spark, tmp_path, algo, params):
    from revtext.plans.jobs import load_model

    _, df = labelled_rows(spark, 120)
    path = str(tmp_path / algo)
    model = train(df, algo, 2, 10, path, **params)
    scored = model.predict(df)
    assert scored.columns == [*df.columns, "probability", "prediction"]
    assert evaluate_predictions(scored).first().accuracy >= 0.7
    again = load_model(spark, path, algo).predict(df)
    assert rows(again, "review_id", "prediction") == rows(scored, "review_id", "prediction")


def test_classes_absent_from_training_keep_their_place(spark):
    _, df = labelled_rows(spark, 40)
    df = df.withColumn("label_ohe", F.concat("label_ohe", F.array([F.lit(0)] * 3)))
    model = train(df, "lr", 5, 10, max_iter=5)
    assert {len(r.probability) for r in model.predict(df).collect()} == {5}


def test_encode_reviews_is_map_only_with_a_given_vocabulary(spark):
    reviews = spark.createDataFrame(
        [(1, "Good <b>thing</b>, really GOOD!", 5), (2, "The of and", 1), (3, None, 2), (4, "good", 3)],
        "review_id long, review_body string, star_rating int",
    )
    vocab = spark.createDataFrame([("good", 3, 1)], "token string, n long, idx int")
    encoded, _ = encode_reviews(reviews, 2, vocab, 3, lemmatizer=VerbLemmatizer(()))
    assert rows(encoded, "review_id", "features", "label_ohe") == [(1, [1, 0, 0], [0, 1])]
    plan = encoded._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    tokens = review_tokens(reviews, lemmatizer=VerbLemmatizer(()))
    once = tokens._jdf.queryExecution().executedPlan().toString().count("regexp_replace(")
    assert plan.count("regexp_replace(") == once
