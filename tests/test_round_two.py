"""Keys, sizes and ranks: what must not change answers."""

import gzip

import pytest
from pyspark.sql import functions as F

from revtext.functions.lookup import MAX_JSON_KEY, Lookup
from revtext.operators import naive_bayes, spark_ml, splitting, vocabulary
from revtext.plans import jobs
from revtext.sinks.datasets import write_dictionary
from revtext.sources.dictionary import read_dictionary
from revtext.sources.reviews import read_reviews

TOKENS = "review_id long, tokens array<string>"


def test_index_paths_agree_on_repeated_null_and_missing_keys(spark):
    rows = [(1, ["a", "b"]), (1, ["x", "c"]), (None, ["c", "c"]), (None, []), (2, None), (3, ["zero"])]
    df = spark.createDataFrame(rows, TOKENS)
    vocab = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("zero", 0)], "token string, idx int")
    for frame in (df, df.drop("review_id")):
        place = vocabulary.index_tokens(frame, vocab)
        joined = vocabulary.index_by_join(frame, vocab, head=1)
        assert place.columns == joined.columns
        assert sorted(map(str, place.collect())) == sorted(map(str, joined.collect()))


def test_scoring_paths_agree_without_keys(spark):
    rows = [([1, 0], [1, 2, 2]), ([0, 1], [3, 0, 0]), ([0, 1], [3, 3, 1]), ([0, 1], [3, 3, 1])]
    df = spark.createDataFrame(rows, "label_ohe array<int>, features array<int>")
    model = naive_bayes.fit_naive_bayes(df, 2, None)
    assert model.vocab_size == 3
    place, joined = model.scores(df), model.scores_by_join(df, 1)
    rounded = lambda f: sorted([round(s, 9) for s in r.scores] for r in f.collect())
    assert rounded(place) == rounded(joined)


def test_no_word_is_lost_to_the_model_size(spark):
    df = spark.createDataFrame([([1, 0], [1, 15]), ([0, 1], [2, 0])], "label_ohe array<int>, features array<int>")
    with pytest.raises(ValueError):
        jobs.train(df, "nb", 2, vocab_size=10)
    with pytest.raises(ValueError):
        spark_ml.fit_logistic_regression(df, 2, 10)
    words = jobs.train(df, "nb", 2).words
    sums = words.groupBy("class").agg(F.sum(F.exp("loglik")).alias("s")).collect()
    assert [r.s for r in sums] == pytest.approx([1.0, 1.0])


def test_small_fractions_give_rows_and_sums_are_checked(spark):
    df = spark.range(2_000_000).withColumnRenamed("id", "review_id")
    n = splitting.sample_rows(df, 1e-4).count()
    assert 120 < n < 290
    assert splitting.sample_rows(spark.range(8_000_000).withColumnRenamed("id", "review_id"), 1e-6).count() > 0
    with pytest.raises(ValueError):
        splitting.split_train_eval(df, 0.7, 0.5)


@pytest.mark.parametrize("size", [1, 3, 40, 500, 5000])
def test_ranks_are_those_of_one_sorted_list(spark, size):
    counts = [(f"w{i}", 1 + (i * 7919 % 97) // 9) for i in range(1200)]
    expected = [
        (t, n, i) for i, (t, n) in enumerate(sorted(counts, key=lambda c: (-c[1], c[0]))[:size], start=1)
    ]
    for parts in (1, 5, 200):
        df = spark.createDataFrame(counts, "token string, n long").repartition(parts)
        got = vocabulary.vocabulary(df, size).orderBy("idx").collect()
        assert [tuple(r) for r in got] == expected


def test_vocabulary_of_nothing(spark):
    assert vocabulary.vocabulary(spark.createDataFrame([], "token string, n long"), 5).collect() == []


def test_dictionary_of_odd_words_and_other_layouts(spark, tmp_path):
    words = [('q"\\', 1), ("{}", 2), ("é, ", 3), ("k" * 60_000, 4), ("a:1}", 5)]
    vocab = spark.createDataFrame(words, "token string, idx int")
    write_dictionary(vocab, str(tmp_path / "d"))
    assert sorted(map(tuple, read_dictionary(spark, str(tmp_path / "d")).collect())) == sorted(words)
    (tmp_path / "one.json").write_text('{"a": 1, "b": 2}')
    (tmp_path / "many.json").write_text('{\n  "a": 1,\n  "b": 2\n}\n')
    for name in ("one", "many"):
        got = read_dictionary(spark, str(tmp_path / f"{name}.json")).collect()
        assert sorted(map(tuple, got)) == [("a", 1), ("b", 2)]


def test_compressed_reviews_without_a_key(spark, tmp_path):
    lines = [f"{1 + 4 * (i % 2)}\tthis {'good fine' if i % 2 else 'bad poor'} item number {i}" for i in range(60)]
    with gzip.open(tmp_path / "r.tsv.gz", "wt") as file:
        file.write("star_rating\treview_body\n" + "\n".join(lines) + "\n")
    reviews = read_reviews(spark, str(tmp_path / "r.tsv.gz"))
    assert reviews.rdd.getNumPartitions() > 1
    prepared = jobs.prepare(reviews, str(tmp_path / "out"), 2, sample=0.5)
    sizes = [f.count() for f in (prepared.train, prepared.evaluation, prepared.test)]
    assert sum(sizes) == 60 and prepared.train_sample.count() < sizes[0]
    model = jobs.train(prepared.train, "nb", 2, prepared.vocab_size)
    found = jobs.predict(model, reviews.drop("star_rating"), prepared.vocab, 2, out=str(tmp_path / "p"))
    assert found.count() == 60
    saved = spark.read.text(str(tmp_path / "p")).collect()
    assert {r.value.split(",", 1)[1] for r in saved} <= {"0,negative", "1,positive"}
    with pytest.raises(ValueError):
        jobs.prepare(reviews, str(tmp_path / "q"), 2, key="nope")


def test_many_long_keys_of_a_lookup(spark):
    keys = {"k" * (MAX_JSON_KEY + i): i for i in range(1, 40)}
    lookup = Lookup(keys, "int")
    df = spark.createDataFrame([(k,) for k in [*keys, "k"]], "v string")
    got = [r.x for r in df.select(lookup.get(F.col("v")).alias("x")).collect()]
    assert sorted(x for x in got if x is not None) == [*range(1, 40)] and None in got
