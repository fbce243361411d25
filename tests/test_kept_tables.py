"""Stored tables, sliced training, rescued lines, lemmas by table, null split keys."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from revtext.functions import lookup
from revtext.functions.lemma import IRREGULAR, VERBS, VerbLemmatizer
from revtext.operators import lemmas, spark_ml, splitting, training
from revtext.plans import jobs
from revtext.sources.reviews import bad_lines, read_reviews, read_reviews_rescued
from revtext.storage import Registry, exists, is_finished, scratch, shared_dir, stage

REVIEW = "review_id long, review_body string, star_rating int"
ENCODED = "label_ohe array<int>, features array<int>"


# Registry and scratch


def test_a_second_run_reads_no_source(spark, tmp_path):
    source, registry = str(tmp_path / "in"), Registry(spark, str(tmp_path / "kept"))
    spark.range(10).write.parquet(source)
    built = []

    def build():
        built.append(1)
        return spark.read.parquet(source).where("id > 3")

    first, reused = registry.table("big", build, [source], least=3)
    assert not reused and first.count() == 6
    again, reused = registry.table("big", build, [source], least=3)
    assert reused and again.schema == first.schema and again.count() == 6 and built == [1]
    assert all("/kept/" in name for name in again.inputFiles())
    assert not registry.table("big", build, [source], least=4)[1]
    spark.range(5).write.mode("append").parquet(source)
    third, reused = registry.table("big", build, [source], least=3)
    assert not reused and third.count() == 7 and len(built) == 3
    registry.release()
    assert not exists(spark, str(tmp_path / "kept"))


def test_a_table_that_broke_off_is_made_anew(spark, tmp_path):
    source, registry = str(tmp_path / "in"), Registry(spark, str(tmp_path / "kept"))
    spark.range(10).write.parquet(source)

    def breaks():
        return spark.read.parquet(source).select(F.when(F.col("id") > 5, F.raise_error(F.lit("lost"))).otherwise(F.col("id").cast("string")).alias("id"))

    with pytest.raises(Exception, match="lost"):
        registry.table("t", breaks, [source])
    made, reused = registry.table("t", lambda: spark.read.parquet(source), [source])
    assert not reused and made.count() == 10


def test_a_finished_job_leaves_no_scratch_table(spark, tmp_path):
    import os

    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    rows = [(i, f"stone river w{i % 7} green", 1 + 4 * (i % 2)) for i in range(80)]
    made = jobs.prepare(spark.createDataFrame(rows, REVIEW), str(tmp_path / "p"), 2, learn_abbreviations=True)
    assert set(os.listdir(folder)) - before == set()
    assert made.train.count() + made.evaluation.count() + made.test.count() == 80 and made.vocab.count() > 0
    with pytest.raises(RuntimeError), scratch(spark):
        kept = stage(spark.range(3), "x")
        assert kept.count() == 3
        raise RuntimeError
    assert set(os.listdir(folder)) - before == set()


# Sliced training


def vectors(spark, seed, n=120):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        y = rng.randrange(2)
        rows.append(([1 - y, y], [rng.choice([1, 2, 3] if y else [4, 5, 6]) if rng.random() < 0.8 else 7 for _ in range(12)]))
    return spark.createDataFrame(rows, ENCODED).coalesce(1)


SLICED = {"num_classes": 2, "steps": 4, "hidden": (4,), "embedding": 6, "num_partitions": 1, "patience": 9}


def history(made):
    return [(r.slice, round(r.train_loss, 9), round(r.loss, 9), r.accuracy, r.best) for r in made.history.orderBy("slice").collect()]


def test_a_run_that_broke_off_ends_in_the_same_model(spark, tmp_path, monkeypatch):
    train, evaluation = vectors(spark, 1), vectors(spark, 2)
    whole = training.train_in_slices(train, evaluation, str(tmp_path / "a"), slices=4, **SLICED)
    real, calls = training.evaluate_predictions, []

    def breaks(scored):
        calls.append(1)
        if len(calls) > 5:
            raise RuntimeError("lost")
        return real(scored)

    monkeypatch.setattr(training, "evaluate_predictions", breaks)
    with pytest.raises(RuntimeError):
        training.train_in_slices(train, evaluation, str(tmp_path / "b"), slices=4, **SLICED)
    assert is_finished(spark, f"{tmp_path}/b/slice-2") and not exists(spark, f"{tmp_path}/b/slice-3")
    monkeypatch.setattr(training, "evaluate_predictions", real)
    again = training.train_in_slices(train, evaluation, str(tmp_path / "b"), slices=4, **SLICED)
    assert history(again) == history(whole)
    a, b = ([[round(p, 9) for p in r.probability] for r in m.model.predict(evaluation).collect()] for m in (whole, again))
    assert a == b
    losses = [r[1] for r in history(whole)]
    assert losses == sorted(losses, reverse=True) and sum(r[4] for r in history(whole)) == 1


def test_training_ends_when_the_loss_does_not_fall(spark, tmp_path):
    train = vectors(spark, 3)
    # Labels of the evaluation rows are wrong, so the first slices are best.
    wrong = vectors(spark, 4).withColumn("label_ohe", F.reverse("label_ohe"))
    options = SLICED | {"patience": 2, "steps": 8}
    made = training.train_in_slices(train, wrong, str(tmp_path / "m"), slices=12, **options)
    rows = history(made)
    best = next(r[0] for r in rows if r[4])
    assert len(rows) == best + 2 < 12
    loss = training.evaluate_predictions(made.model.predict(wrong)).first().log_loss
    assert loss == pytest.approx(rows[best - 1][2], rel=1e-6)
    path = str(tmp_path / "saved")
    made.model.save(path)
    assert spark_ml.load_spark_ml(path).predict(wrong).count() == wrong.count()


def test_slices_of_batches(spark, tmp_path):
    options = SLICED | {"batch_share": 0.5, "block_size": 16}
    made = training.train_in_slices(vectors(spark, 5), vectors(spark, 6), str(tmp_path / "m"), slices=3, **options)
    assert [r[0] for r in history(made)] == [1, 2, 3] and history(made)[-1][3] > 0.6


def test_word_order_counts_with_trigrams(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(200):
        y = rng.randrange(2)
        noise = [rng.randint(4, 9) for _ in range(6)]
        rows.append(([1 - y, y], [*noise, *([1, 2, 3] if y else [3, 2, 1])]))
    df = spark.createDataFrame(rows, ENCODED).coalesce(1)

    def accuracy(cells):
        model = spark_ml.fit_logistic_regression(df, 2, 9, 30, num_partitions=1, trigram_cells=cells)
        return training.evaluate_predictions(model.predict(df)).first().accuracy

    assert accuracy(0) < 0.75 and accuracy(1 << 12) == 1.0


# Sources


def test_malformed_lines_are_kept_aside(spark, tmp_path):
    good = "review_id\tstar_rating\treview_body\n1\t5\tfine\n2\t\t\n"
    (tmp_path / "a.tsv").write_text(good + "3\t4\n4\tfive\tx\n5\t1\ta\tb\n\t1\tno key\n\n")
    with gzip.open(tmp_path / "b.tsv.gz", "wt") as file:
        file.write(good.replace("\n", "\r\n") + "6\t3\tlast \"open\n")
    read = read_reviews_rescued(spark, str(tmp_path))
    rows = {r.review_id: (r.star_rating, r.review_body) for r in read.where("_rescued is null and _file like '%b.tsv.gz'").collect()}
    assert rows == {"1": (5, "fine"), "2": (None, ""), "6": (3, 'last "open')}
    rescued = sorted(r._rescued for r in read.where("_rescued is not null").collect())
    assert rescued == ["", "\t1\tno key", "3\t4", "4\tfive\tx", "5\t1\ta\tb"]
    assert read.where("_rescued is not null and (review_id is not null or star_rating is not null)").count() == 0
    found = {r["_file"].rsplit("/")[-1]: (r.lines, r.bad) for r in bad_lines(read).collect()}
    assert found == {"a.tsv": (7, 5), "b.tsv.gz": (3, 0)}
    with pytest.raises(ValueError, match="a.tsv: 5 of 7"):
        read_reviews_rescued(spark, str(tmp_path), max_bad_share=0.5)
    assert read_reviews_rescued(spark, str(tmp_path), max_bad_share=0.8).count() == 10
    with pytest.raises(ValueError, match="lacks"):
        read_reviews_rescued(spark, str(tmp_path), body="text")


def test_a_folder_of_compressed_files_is_dealt_over_the_cores(spark, tmp_path):
    with gzip.open(tmp_path / "a.tsv.gz", "wt") as file:
        file.write("review_id\treview_body\n" + "".join(f"{i}\tbody {i}\n" for i in range(500)))
    read = read_reviews(spark, str(tmp_path))
    assert read.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and read.count() == 500


# Lemmas by table


def lemma_tables(spark, lexicon, exceptions):
    listed = [(f, i, x) for f, found in exceptions.items() for i, x in enumerate(found, 1)]
    return (
        spark.createDataFrame([(v,) for v in lexicon], "lemma string"),
        spark.createDataFrame(listed, "form string, ord int, lemma string"),
    )


@pytest.mark.parametrize("limit", [lookup.MAX_ENTRIES, 3])
def test_lemmas_by_table_are_those_of_the_constant(spark, monkeypatch, limit):
    rng = random.Random(8)
    words = [*VERBS, *IRREGULAR, "feelings", "es", "s", "ing", "sings", "x" * 300 + "ings", "seeded" * 9, "", "é", "needinges", "s" * 50]
    endings = ["", "s", "es", "ed", "ing", "ies", "ings", "eds", "inges"]
    rows = [[rng.choice(words) + rng.choice(endings) for _ in range(9)] for _ in range(400)] + [[], None, ["walks", None]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, tokens array<string>")
    want = {r.id: r.t for r in df.select("id", VerbLemmatizer().lemmas(F.col("tokens")).alias("t")).collect()}
    tables = lemma_tables(spark, VERBS, IRREGULAR)
    monkeypatch.setattr(lookup, "MAX_ENTRIES", limit)
    got = {r.id: r.tokens for r in lemmas.lemmatize_table(df, *tables).collect()}
    assert got == want


def test_only_words_that_may_change_leave_their_task(spark, monkeypatch):
    stored, real = {}, lemmas.stage
    monkeypatch.setattr(lemmas, "stage", lambda df, label, *a, **b: stored.setdefault(label, real(df, label, *a, **b)))
    stay = spark.range(5000).select(F.array(F.concat(F.lit("w"), "id"), F.lit("walks"), F.lit("walkeds"), F.lit("went")).alias("tokens"))
    tables = lemma_tables(spark, VERBS, IRREGULAR)
    done = lemmas.lemmatize_table(stay, *tables)
    assert done.where("tokens[1] = 'walk' and tokens[2] = 'walk' and tokens[3] = 'go' and tokens[0] like 'w%'").count() == 5000
    assert done.select("tokens").distinct().count() == 5000
    assert 3 <= stored["direct-lemmas"].count() < 500
    words = stay.select(F.explode("tokens").alias("word")).distinct()
    plan = lemmas.word_lemmas(words, *tables)
    assert {(r.word, r.lemma) for r in plan.collect()} == {("walks", "walk"), ("walkeds", "walk"), ("went", "go")}


def test_more_changed_words_than_the_set_holds(spark, monkeypatch):
    df = spark.createDataFrame([(["walks", "stone", "", None, "went"],), ([],), (None,)], "tokens array<string>")
    tables = lemma_tables(spark, VERBS, IRREGULAR)
    want = [["walk", "stone", "", None, "go"], [], None]
    for most in (lemmas.MAX_LISTED, 1):
        monkeypatch.setattr(lemmas, "MAX_LISTED", most)
        assert [r.tokens for r in lemmas.lemmatize_table(df, *tables).collect()] == want


def test_a_lexicon_of_300_000_forms(spark):
    lexicon = spark.range(100_000).select(F.concat(F.lit("verb"), "id", F.lit("e")).alias("lemma"))
    assert lemmas.regular_forms(lexicon).count() >= 300_000
    df = spark.createDataFrame([(["verb7ed", "verb99999ing", "verb5es", "verb100000ed"],)], "tokens array<string>")
    assert lemmas.lemmatize_table(df, lexicon).first().tokens == ["verb7e", "verb99999e", "verb5e", "verb100000ed"]
    assert lemmas.lemmatize_table(df, lexicon.where("false")).first().tokens[0] == "verb7ed"


# Splits


def test_rows_without_a_key_are_split_like_others(spark):
    rows = [(None, f"body {i}", 1) for i in range(1000)] + [(i, "body", 1) for i in range(1000)]
    df = spark.createDataFrame(rows, REVIEW)
    work, held_out = splitting.split_test(df, 0.2)
    assert 140 < held_out.where("review_id is null").count() < 260
    again = splitting.split_test(df.orderBy(F.rand(1)).repartition(7), 0.2)[1]
    assert sorted(map(str, again.collect())) == sorted(map(str, held_out.collect()))
    sampled = splitting.sample_rows(work, 0.3).where("review_id is null").count()
    assert 170 < sampled < 310
