"""Abbreviations, two-pass frequent words, the filtered dictionary join, evaluation, added reviews."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from revtext.functions import bloom, lookup
from revtext.functions.abbreviations import MARK
from revtext.operators import abbreviations as abbr
from revtext.operators import evaluation, frequent, vocabulary
from revtext.plans import incremental, jobs
from revtext.storage import stage


def texts_of(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")


# Abbreviations


def corpus():
    rng = random.Random(1)
    words = "stone river house green light small bridge winter paper table".split()
    lines = []
    for _ in range(400):
        said = [rng.choice(words) for _ in range(8)]
        said.insert(rng.randrange(8), rng.choice(["e.g.", "approx.", "u.s."]))
        lines.append(" ".join(said) + ".")
    return lines


def plain_score(word, finals, plains, share):
    ratio = -2 * (
        finals * math.log(share) + plains * math.log(1 - share) - finals * math.log(0.99) - plains * math.log(0.01)
    )
    letters = len(word.replace(".", ""))
    return ratio * math.exp(-letters) * (len(word) - letters + 1) * letters**-plains


def test_scores_are_those_of_the_method(spark):
    lines = corpus()
    counts = Counter(w for line in lines for w in line.split())
    words = {w.removesuffix(".") for w in counts}
    finals = {w: counts[w + "."] for w in words}
    plains = {w: counts[w] for w in words}
    share = sum(finals.values()) / sum(counts.values())
    got = {r.word: r for r in abbr.learn_abbreviations(texts_of(spark, *lines), least=None).collect()}
    assert set(got) == {w for w in words if finals[w]}
    for w, r in got.items():
        assert (r.n_final, r.n_plain) == (finals[w], plains[w])
        assert r.score == pytest.approx(plain_score(w, finals[w], plains[w], share), rel=1e-9)
    kept = {r.word for r in abbr.learn_abbreviations(texts_of(spark, *lines)).collect()}
    assert kept == {"e.g", "approx", "u.s"}


SAID = [
    ("it is approx. five (e.g. here) now.", "it is approx. five ( e.g. here ) now ."),
    ("see the u.s.", "see the u.s ."),
    ("see the u.s. \n", "see the u.s ."),
    ("xapprox. yes", "xapprox . yes"),
    ("approx., then e.g.\n\nfive", "approx. , then e.g. five"),
    ("", ""),
    (None, None),
    ("no period", "no period"),
    (f"odd {MARK} e.g. x", "odd � e.g. x"),
]


@pytest.mark.parametrize("limit", [lookup.MAX_ENTRIES, 1])
def test_abbreviations_keep_their_period_inside_a_text(spark, monkeypatch, limit):
    monkeypatch.setattr(lookup, "MAX_ENTRIES", limit)
    table = spark.createDataFrame([("e.g",), ("approx",), ("u.s",), ("e.g",)], "word string")
    df = texts_of(spark, *(t for t, _ in SAID)).withColumn("tokens", F.lit("clash"))
    split = abbr.tokenize_learned(df, table, F.col("text"), "words")
    got = {r.id: r.words and " ".join(r.words) if r.words != [] else "" for r in split.collect()}
    assert got == {i: want for i, (_, want) in enumerate(SAID)}


def test_no_abbreviations_and_no_texts(spark):
    none = abbr.learn_abbreviations(texts_of(spark).where("false"))
    assert none.collect() == []
    split = abbr.tokenize_learned(texts_of(spark, "e.g. this."), none, F.col("text"), "words")
    assert split.first().words == ["e.g", ".", "this", "."]


def test_prepare_learns_them_and_predict_is_given_them(spark, tmp_path):
    rows = [(i, line + " no. five", 1 + 4 * (i % 2)) for i, line in enumerate(corpus())]
    reviews = spark.createDataFrame(rows, "review_id long, review_body string, star_rating int")
    made = jobs.prepare(reviews, str(tmp_path / "p"), 2, learn_abbreviations=True, vocab_size=50)
    assert {r.word for r in made.abbreviations.collect()} >= {"e.g", "approx", "u.s", "no"}
    # "no." is no stop word, so it is a word of the dictionary.
    assert "no" in {r.token for r in made.vocab.collect()}
    model = jobs.train(made.train, "nb", 2, 50)
    scored = jobs.predict(model, reviews, made.vocab, 2, abbreviations=made.abbreviations)
    assert scored.count() == len(rows) and scored.where("prediction is null").count() == 0


# Frequent words in two passes


def token_rows(spark, rows, partitions=6):
    df = spark.createDataFrame([(r,) for r in rows], "tokens array<string>")
    return stage(df.repartition(partitions), "tokens")


def zipf_rows(n=3000):
    rng = random.Random(2)
    often = lambda: f"w{int(rng.paretovariate(0.9)) % 40_000}"
    return [[often() for _ in range(15)] + [f"u{rng.randrange(10**9)}" for _ in range(5)] for _ in range(n)]


def test_candidates_hold_the_most_frequent(spark):
    df = token_rows(spark, [*zipf_rows(), [], None, ["x", None]])
    exact = vocabulary.term_counts(df)
    want = [tuple(r) for r in vocabulary.vocabulary(exact, 50).orderBy("idx").collect()]
    counted = frequent.frequent_counts(df, 50, 400)
    assert [tuple(r) for r in vocabulary.vocabulary(counted, 50).orderBy("idx").collect()] == want
    # Neither pass moves more than a bounded number of words of a task.
    tasks = df.rdd.getNumPartitions()
    every = df.select(F.spark_partition_id().alias("p"), F.explode("tokens").alias("t")).distinct().count()
    first = frequent.frequency_sketch(df, 400).where("token is not null").count()
    assert every > 15_000 and first <= 400 * tasks and counted.count() < 1000


def test_counters_bound_every_count(spark):
    df = token_rows(spark, zipf_rows(500), 3)
    true = {r.token: r.n for r in vocabulary.term_counts(df).collect()}
    sketch = frequent.frequency_sketch(df, 60).groupBy("token").agg(F.sum("low").alias("low"), F.sum("lost").alias("lost"))
    rows = {r.token: r for r in sketch.collect()}
    lost = rows.pop(None).lost
    assert 0 < lost <= sum(true.values()) / 61
    assert all(rows[t].low <= n <= rows[t].low + lost if t in rows else n <= lost for t, n in true.items())


@pytest.mark.parametrize("rows", [[], [["a"]], [["a", "b", "a"], ["c"]], [[f"u{i}"] for i in range(300)]])
def test_few_words_ties_and_nothing(spark, rows):
    df = token_rows(spark, rows, 2)
    want = vocabulary.vocabulary(vocabulary.term_counts(df), 10).orderBy("idx").collect()
    for counters in (2, 100):
        assert vocabulary.vocabulary(frequent.frequent_counts(df, 10, counters), 10).orderBy("idx").collect() == want


# The filtered dictionary join


def test_filter_holds_its_words_and_few_others(spark):
    table = spark.range(5000).select(F.concat(F.lit("w"), "id").alias("token"))
    table = table.unionByName(spark.createDataFrame([("",), (None,), ("é" * 5000,)], "token string"))
    held = bloom.BloomFilter(table)
    assert table.where("token is not null").where(~held.may_hold(F.col("token"))).count() == 0
    others = spark.range(20_000).select(F.concat(F.lit("x"), "id").alias("token"))
    assert others.where(held.may_hold(F.col("token"))).count() < 0.02 * 20_000
    empty = bloom.BloomFilter(table.where("false"))
    assert others.where(empty.may_hold(F.col("token"))).count() == 0


def test_words_outside_the_dictionary_do_not_move(spark):
    rng = random.Random(3)
    rows = [["noise"] * 20 + [f"w{rng.randrange(3000)}" for _ in range(10)] + [f"z{rng.randrange(10**6)}" for _ in range(10)] for _ in range(800)]
    df = token_rows(spark, rows)
    vocab = spark.range(1, 3001).select(F.concat(F.lit("w"), F.col("id") - 1).alias("token"), F.col("id").cast("int").alias("idx"))
    got = vocabulary.index_by_join(df, vocab, head=100)
    index = {f"w{i}": i + 1 for i in range(3000)}
    want = Counter(tuple(index.get(t, 0) for t in r) for r in rows)
    assert Counter(tuple(r.idx) for r in got.select("idx").collect()) == want
    known = sum(t in index for r in rows for t in r)
    moved = df.select(F.explode("tokens").alias("t")).where(bloom.BloomFilter(vocab.where("idx > 100")).may_hold(F.col("t"))).count()
    assert moved <= known + 0.02 * 30 * len(rows)


def test_a_frequent_word_that_passes_the_filter_stays_in_place(spark, monkeypatch):
    monkeypatch.setattr(vocabulary, "HOT_SAMPLE", 1.0)
    df = token_rows(spark, [["hot"] * 50 + [f"w{i}"] for i in range(300)])
    entries = spark.createDataFrame([("hot", -7)] + [(f"w{i}", -i - 10) for i in range(200)], "token string, neg int")
    found = vocabulary._hot_words(df, entries, lookup.Lookup({}, "int"), lambda t: F.lit(True), "tokens")
    assert found["hot"] == 7 and found["w299"] == 0 and found["w3"] == 13


# Evaluation


def plain_auc(rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else None


@pytest.mark.parametrize("levels", [1, 7, 10**6])
def test_area_counts_every_pair(spark, levels):
    rng = random.Random(levels)
    rows = [(c, rng.randrange(levels) / levels, rng.random() < 0.2 + 0.1 * c) for c in (0, 1) for _ in range(700)]
    rows += [(2, 0.5, True), (2, 0.7, True), (0, None, True), (1, 0.5, None)]
    got = evaluation.auc(spark.createDataFrame(rows, "class int, score double, positive boolean").repartition(5))
    got = {r["class"]: r for r in got.collect()}
    for c in (0, 1, 2):
        own = [(s, y) for k, s, y in rows if k == c and s is not None and y is not None]
        assert (got[c].positives, got[c].negatives) == (sum(y for _, y in own), sum(not y for _, y in own))
        assert got[c].auc == (pytest.approx(plain_auc(own), abs=1e-12) if c < 2 else None)


def test_confusion_and_calibration(spark):
    rows = [([0.9, 0.1], 0, [1, 0]), ([0.8, 0.2], 0, [0, 1]), ([1.0, 0.0], 0, [1, 0])]
    scored = spark.createDataFrame(rows, "probability array<double>, prediction int, label_ohe array<int>")
    cells = {(r.label, r.prediction): (r.n, r.share) for r in evaluation.confusion(scored, 2).collect()}
    assert cells == {(0, 0): (2, 1.0), (0, 1): (0, 0.0), (1, 0): (1, 1.0), (1, 1): (0, 0.0)}
    bins = evaluation.calibration(evaluation.class_scores(scored))
    got = {(r["class"], r.bin): (r.n, r.mean_score, r.observed) for r in bins.collect()}
    assert got[0, 9] == (2, pytest.approx(0.95), 1.0) and got[0, 8] == (1, 0.8, 0.0) and got[1, 0] == (1, 0.0, 0.0)
    error = {r["class"]: r.error for r in evaluation.calibration_error(bins).collect()}
    assert error[0] == pytest.approx((2 * 0.05 + 0.8) / 3)


# Added reviews


def review_rows(n, seed, words):
    rng = random.Random(seed)
    return [(seed * 1000 + i, " ".join(rng.choices(words, k=rng.randint(1, 130))), rng.choice([1, 2, 4, 5, 3])) for i in range(n)]


REVIEW = "review_id long, review_body string, star_rating int"


def data_sets(made):
    def lines(df, *columns):
        return sorted(map(str, df.select(*columns).collect()))

    return [
        lines(made.train, "review_id", "star_rating", "features", "label_ohe"),
        lines(made.evaluation, "review_id", "star_rating", "features", "label_ohe"),
        lines(made.test, "review_id", "review_body", "star_rating"),
        lines(made.vocab, "token", "n", "idx"),
    ]


@pytest.mark.parametrize("train_only", [False, True])
def test_added_reviews_equal_a_preparation_of_all(spark, tmp_path, train_only):
    old = review_rows(150, 1, [f"old{i}" for i in range(80)] + ["both", "late"])
    # Rows whose only known word goes, rows known by a word past the first 100 only, null and repeated ids.
    old += [(7000, "old79 " * 2, 5), (7001, "rare " * 105 + "both", 5), (7002, "", 1), (None, "both late", 5), (1001, "late", 4)]
    new = review_rows(60, 2, [f"new{i}" for i in range(30)] + ["late"] * 20) + [(1002, "both new1", 5), (None, "late", 1)]
    frames = {k: spark.createDataFrame(v, REVIEW) for k, v in (("old", old), ("new", new), ("all", old + new))}
    options = {"num_classes": 2, "vocab_size": 60, "vocab_from_train_only": train_only, "test": 0.1, "evaluation": 0.2}
    jobs.prepare(frames["old"], str(tmp_path / "old"), **options)
    made = incremental.prepare_incremental(spark, str(tmp_path / "old"), frames["new"], str(tmp_path / "new"))
    whole = jobs.prepare(frames["all"], str(tmp_path / "all"), **options)
    assert data_sets(made) == data_sets(whole)
    # Once more on top of that.
    more = spark.createDataFrame(review_rows(40, 3, ["late", "third", "new3"]), REVIEW)
    again = incremental.prepare_incremental(spark, str(tmp_path / "new"), more, str(tmp_path / "more"))
    whole = jobs.prepare(frames["all"].unionByName(more), str(tmp_path / "all2"), **options)
    assert data_sets(again) == data_sets(whole)


def test_most_old_rows_go_through_the_index_map(spark, tmp_path, monkeypatch):
    old = review_rows(200, 4, [f"w{i}" for i in range(50)])
    jobs.prepare(spark.createDataFrame(old, REVIEW), str(tmp_path / "old"), 2, vocab_size=50)
    encoded = []
    real = incremental.encode_tokens
    monkeypatch.setattr(incremental, "encode_tokens", lambda df, *a: encoded.append(df.count()) or real(df, *a))
    # The old words keep their places in other order; one new word pushes the last one out.
    new = [(9000 + i, "w3 w3 w4 fresh " * 30, 5) for i in range(40)]
    incremental.prepare_incremental(spark, str(tmp_path / "old"), spark.createDataFrame(new, REVIEW), str(tmp_path / "new"))
    assert encoded and encoded[0] <= 45


def test_a_preparation_that_broke_off_is_not_built_on(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        incremental.prepare_incremental(spark, str(tmp_path), spark.createDataFrame([], REVIEW), str(tmp_path / "x"))


