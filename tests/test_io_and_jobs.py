"""Files in and out, and the jobs end to end."""

import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from revtext.plans import jobs
from revtext.sinks import datasets
from revtext.sources.dictionary import read_dictionary
from revtext.sources.encoded import read_encoded_csv, read_xy_csv, with_line_number
from revtext.sources.lexicon import read_verb_lexicon
from revtext.sources.reviews import read_reviews


def lines(path):
    return [line for part in sorted(Path(path).glob("part-*")) for line in part.read_text().splitlines()]


def test_reviews_with_an_unclosed_quote(spark, tmp_path):
    path = tmp_path / "r.tsv"
    path.write_text(
        "marketplace\treview_id\tstar_rating\treview_body\treview_date\n"
        'US\tR1\t4\t"Great start\t2015-08-31\n'
        "US\tR2\tbad\tplain  \t2015-08-31\n"
        "US\tR3\t5\t\t2015-08-31\n"
    )
    got = read_reviews(spark, str(path)).orderBy("review_id").collect()
    assert [r.review_body for r in got] == ['"Great start', "plain  ", None]
    assert [r.star_rating for r in got] == [4, None, 5]
    assert [r.review_date for r in got] == ["2015-08-31"] * 3


def test_raw_reviews_keep_every_character(spark, tmp_path):
    bodies = ['"a', 'b"c\td', "e\nf", "g\r\nh", "back\\slash\\", "  pad  ", "é", 'x\\"y', "\\"]
    df = spark.createDataFrame(list(enumerate(bodies)), "review_id int, review_body string")
    df = df.withColumn("star_rating", F.lit(5))
    path = str(tmp_path / "raw")
    datasets.write_raw_reviews(df, path)
    got = read_reviews(spark, path, quote='"', multiline=True).collect()
    assert {int(r.review_id): r.review_body for r in got} == dict(enumerate(bodies))


def encoded_rows(spark, n=25, classes=2):
    data = [
        (i, [i % 7, 0, i], [int(i % classes == c) for c in range(classes)]) for i in range(n)
    ]
    return data, spark.createDataFrame(
        data, "review_id long, features array<int>, label_ohe array<int>"
    )


@pytest.mark.parametrize("classes", [2, 5])
def test_encoded_csv_round_trip(spark, tmp_path, classes):
    data, df = encoded_rows(spark, classes=classes)
    path = str(tmp_path / "train")
    datasets.write_encoded(df, path, classes, "csv", length=3)
    assert sorted(lines(path)) == sorted(",".join(map(str, f + label)) for _, f, label in data)
    got = read_encoded_csv(spark, path, classes, 3).collect()
    assert sorted((r.features, r.label_ohe) for r in got) == sorted((f, label) for _, f, label in data)


@pytest.mark.parametrize("keyed", [True, False])
def test_xy_files_pair_rows(spark, tmp_path, keyed):
    data, df = encoded_rows(spark, 200)
    x, y = str(tmp_path / "x"), str(tmp_path / "y")
    datasets.write_xy_csv(df.repartition(5, "review_id"), x, y, 2, 3, keyed)
    got = read_xy_csv(spark, x, y, 2, 3, keyed).collect()
    assert sorted((r.features, r.label_ohe) for r in got) == sorted((f, label) for _, f, label in data)


def test_string_keys(spark, tmp_path):
    data, df = encoded_rows(spark, 30)
    df = df.withColumn("review_id", F.concat(F.lit("R"), "review_id"))
    x, y = str(tmp_path / "x"), str(tmp_path / "y")
    datasets.write_xy_csv(df, x, y, 2, 3)
    got = read_xy_csv(spark, x, y, 2, 3, key_type="string").collect()
    assert sorted((int(r.review_id[1:]), r.features, r.label_ohe) for r in got) == data


def test_header_line_is_read_only_when_declared(spark, tmp_path):
    path = tmp_path / "one.csv"
    path.write_text("a,b,c\n1,0,1\n")
    assert read_encoded_csv(spark, str(path), 2, 1, header=True).count() == 1
    path.write_text("1,0,1\n2,1,0\n")
    assert read_encoded_csv(spark, str(path), 2, 1).count() == 2


def test_line_numbers_follow_the_file_over_splits(spark, tmp_path):
    path = tmp_path / "n.csv"
    path.write_text("".join(f"{i}\n" for i in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        scan = spark.read.schema("v long").csv(str(path))
        assert scan.rdd.getNumPartitions() > 3
        assert with_line_number(scan).where("v <> line").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_dictionary_round_trip(spark, tmp_path):
    words = ["good", 'q"uote', "back\\slash", "é", "k" * 60_000]
    vocab = spark.createDataFrame(
        [(w, 10 - i, i + 1) for i, w in enumerate(words)], "token string, n long, idx int"
    )
    path = str(tmp_path / "dictionary")
    datasets.write_dictionary(vocab, path)
    parts = sorted(p for p in os.listdir(path) if p.startswith("part-"))
    document = "".join((tmp_path / "dictionary" / p).read_text() for p in parts)
    assert json.loads(document) == {w: i + 1 for i, w in enumerate(words)}
    assert list(json.loads(document)) == words
    got = read_dictionary(spark, path)
    assert {r.token: r.idx for r in got.collect()} == {w: i + 1 for i, w in enumerate(words)}
    pretty = tmp_path / "pretty.json"
    pretty.write_text(json.dumps({"a": 1, "b": 2}, indent=1))
    assert {r.token: r.idx for r in read_dictionary(spark, str(pretty)).collect()} == {"a": 1, "b": 2}


def test_predictions_file(spark, tmp_path):
    df = spark.createDataFrame([(1, 4), (2, None)], "review_id long, prediction int")
    datasets.write_predictions(df, str(tmp_path / "keyed"))
    assert sorted(lines(tmp_path / "keyed")) == ["1,5", "2,"]
    datasets.write_predictions(df.where("prediction IS NOT NULL"), str(tmp_path / "bare"), keyed=False)
    assert lines(tmp_path / "bare") == ["5"]


def test_lexicon_files(spark, tmp_path):
    index, listed = tmp_path / "index.verb", tmp_path / "verb.exc"
    index.write_text("  1 licence text\n  2 more\nhope v 2 0 2 1 1\nbe v 1\nback_up v 1\n")
    listed.write_text("was be\nwere be\n")
    lemmatizer = read_verb_lexicon(spark, str(index), str(listed))
    df = spark.createDataFrame([("hopes",), ("was",), ("back_ups",)], "w string")
    got = [r[0] for r in df.select(lemmatizer.lemma(F.col("w"))).collect()]
    assert got == ["hope", "be", "back_ups"]


def review_rows(spark):
    good = ["great value, works really well", "I love this, buying again", "works great"]
    poor = ["broke after a day, terrible", "waste of money; it stopped working", "terrible thing"]
    data = [
        (i, f"{(good if i % 3 else poor)[i % 2]} number{i % 11}", 5 if i % 3 else 1)
        for i in range(400)
    ]
    data += [(400, "plain", 3), (401, None, 4), (402, "the and of", 2)]
    return spark.createDataFrame(data, "review_id long, review_body string, star_rating int")


@pytest.mark.parametrize("from_train", [False, True])
def test_prepare_train_evaluate_predict(spark, tmp_path, from_train):
    reviews = review_rows(spark)
    out = str(tmp_path / "out")
    prepared = jobs.prepare(
        reviews, out, 2, test=0.2, evaluation=0.1, sample=0.5, fmt="csv",
        vocab_from_train_only=from_train,
    )
    sizes = [d.count() for d in (prepared.train, prepared.evaluation, prepared.test)]
    dropped = 2  # rows 401 and 402 have no words, whichever part they are in
    assert sum(sizes) in range(402 - dropped, 403)
    assert len(lines(f"{out}/train_csv")) == sizes[0]
    assert len(lines(f"{out}/eval_x")) == len(lines(f"{out}/eval_y")) == sizes[1]
    assert 0 < len(lines(f"{out}/train_sample")) < sizes[0]

    from_csv = jobs.train(read_encoded_csv(spark, f"{out}/train_csv", 2), "nb", 2)
    xy = read_xy_csv(spark, f"{out}/eval_x", f"{out}/eval_y", 2)
    assert jobs.evaluate(from_csv, xy).first().accuracy > 0.95

    model = jobs.train(prepared.train, "nb", 2, path=f"{out}/model")
    assert jobs.evaluate(model, prepared.evaluation).first().accuracy > 0.95
    vocab = read_dictionary(spark, f"{out}/dictionary")
    loaded = jobs.load_model(spark, f"{out}/model")
    raw = read_reviews(spark, f"{out}/test_tsv", quote='"', multiline=True)
    assert jobs.evaluate_raw(loaded, raw, vocab, 2).first().accuracy > 0.95

    scored = jobs.predict(loaded, reviews.drop("star_rating"), vocab, 2, out=f"{out}/pred")
    by_id = {r.review_id: r for r in scored.collect()}
    assert len(by_id) == 403 and len(lines(f"{out}/pred")) == 403
    assert by_id[401].prediction is None and by_id[402].label is None
    assert by_id[1].label == "positive" and by_id[3].label == "negative"


def test_prepare_without_test_split(spark, tmp_path):
    prepared = jobs.prepare(review_rows(spark), str(tmp_path / "o"), 5, test=None)
    assert prepared.test is None
    share = prepared.evaluation.count() / (prepared.train.count() + prepared.evaluation.count())
    assert 0.02 < share < 0.1


def test_unknown_algorithm(spark):
    with pytest.raises(ValueError):
        jobs.train(spark.range(1), "svm")
