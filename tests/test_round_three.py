"""Work that grows with the tables and no faster: scores, solver tasks, word vectors, counted pieces."""

from pyspark.sql import functions as F

from revtext.functions.tokens import tokenize
from revtext.operators import abbreviations as abbr
from revtext.operators import spark_ml, training
from revtext.operators.evaluation import confusion
from revtext.operators.naive_bayes import fit_naive_bayes


def encoded_rows(spark, n, partitions=1):
    features = F.array(*[(F.col("id") % 5 + i % 3).cast("int") for i in range(6)])
    label = F.array((F.col("id") % 2).cast("int"), (1 - F.col("id") % 2).cast("int"))
    return spark.range(0, n, 1, partitions).select(F.col("id").alias("review_id"), features.alias("features"), label.alias("label_ohe"))


def test_scores_of_grouped_predictions_are_computed_once(spark):
    rows = encoded_rows(spark, 40)
    model = fit_naive_bayes(rows, 2, 8)
    cells = confusion(model.predict(rows), 2)
    plan = cells._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(features") == 2  # one for each class
    found = {(r.label, r.prediction): r.n for r in cells.collect()}
    each = model.predict(rows).collect()
    for (label, prediction), n in found.items():
        assert n == sum(r.label_ohe.index(1) == label and r.prediction == prediction for r in each)


def test_probabilities_of_null_scores_are_null(spark):
    rows = encoded_rows(spark, 4)
    model = fit_naive_bayes(rows, 2, 8)
    null = rows.select("review_id", F.lit(None).cast("array<int>").alias("features"), "label_ohe")
    for r in model.predict(null).collect():
        assert r.prediction is None and (r.probability is None or set(r.probability) == {None})


def test_a_large_table_keeps_tasks_for_its_rows(spark, monkeypatch):
    monkeypatch.setattr(spark_ml, "SOLVER_ROWS", 10)
    rows = encoded_rows(spark, 60, 12)
    parts = lambda n: spark_ml.training_rows(rows, 2, n).rdd.getNumPartitions()
    assert (parts(1), parts(8), parts(None)) == (6, 8, 12)
    assert spark_ml.training_rows(rows.where("review_id < 19"), 2, 1).rdd.getNumPartitions() == 1


def test_slices_learn_word_vectors_in_parts(spark, monkeypatch, tmp_path):
    made, plain = [], training.Word2Vec
    monkeypatch.setattr(training, "Word2Vec", lambda **given: (made.append(given["numPartitions"]), plain(**given))[1])
    monkeypatch.setattr(spark_ml, "EMBEDDING_ROWS", 20)
    rows = encoded_rows(spark, 50)
    for name, given in (("by-rows", None), ("given", 2)):
        done = training.train_in_slices(
            rows, rows, str(tmp_path / name), 2, slices=1, steps=1, embedding=4, hidden=(4,), embedding_partitions=given
        )
        assert done.model.predict(rows).count() == 50
    assert made == [3, 2]


def test_pieces_are_counted_before_they_are_searched(spark):
    texts = spark.createDataFrame([("dr. who (dr.) dr",), ("dr. who, 7. ...",), (None,), ("",)], "text string")
    counts = abbr.word_periods(texts)
    assert {(r.word, r.n_final, r.n_plain) for r in counts.collect()} == {("dr", 3, 1), ("who", 0, 2)}
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" not in plan[plan.index("Aggregate [piece") :]


def test_contractions_behind_quotes_and_each_other(spark):
    def split(text):
        return spark.createDataFrame([(text,)], "text string").select(tokenize(F.col("text"))).first()[0]

    assert split("he's she'd i'm dogs' they'll we've you're") == (
        "he 's she 'd i 'm dogs ' they 'll we 've you 're".split()
    )
    assert split("don't n't 's won't") == "do n't n't 's wo n't".split()
