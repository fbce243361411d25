"""The registered queries and the pipeline on small tables."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from revtext.llm.queries import ORACLE, QUERIES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with edge rows: nulls, repeated rows, near copies, junk, and labels for some."""
    folder = tmp_path_factory.mktemp("tables")
    rows = []
    for i in range(120):
        words = [f"w{(i * 31 + k * k) % 97}" for k in range(60)]
        rows.append((i, " ".join(words), "en", f"s{i % 3}"))
    rows += [(200 + i, "BUY!! NOW$$$ " * (20 + i), "en", "s0") for i in range(60)]
    rows += [(300, rows[0][1], "en", "s1"), (301, rows[1][1] + " mail x@y.org", "en", None)]
    rows += [(302, None, None, None), (303, "", "en", "s2"), (None, rows[2][1], "en", "s0"), rows[5], rows[5]]
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], SCHEMA)
    docs.coalesce(2).write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], int(not (200 <= r[0] < 300)), 0) for r in rows[:180]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_keep_the_columns_and_take_effect(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    sizes = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, tables).cache()
        sizes[name] = docs.count()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == COLUMNS
        if name == "quality":
            assert docs.where(F.col("text").startswith("BUY")).count() == 0
            assert docs.where(F.col("text").startswith("w")).count() == 120 + 3 + 2
        if name == "near_duplicates":
            assert docs.where(F.col("text").startswith("w")).count() == docs.select("text").distinct().where("text <> ''").count()
        if name == "personal_data":
            assert docs.where(F.col("text").contains("@")).count() == 0
        if name == "mix":
            mixed = sum(r.n for r in docs.groupBy("doc_id").agg(F.count("*").alias("n")).collect())
            assert mixed == sizes["mix"] and docs.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    whole = docs.agg(F.sum("length"), F.sum(F.when(F.col("start") == 0, F.col("doc_tokens")))).first()
    assert whole[0] == whole[1]
    assert docs.where("start = 0").count() == sizes["mix"]


def test_run_gives_the_same_again(spark, tables):
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    first = sorted(map(str, corpus_pipeline.run(spark, tables).select(*columns).collect()))
    assert first == sorted(map(str, corpus_pipeline.run(spark, tables).select(*columns).collect()))


def test_more_columns_and_empty_tables_pass(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").withColumn("size", F.lit("x")).withColumn("fp", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tables)
        assert docs.columns == [*COLUMNS, "size", "fp"]
        assert stage(spark, docs.where("doc_id < -5"), tables).count() == 0


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ("op2_chat_format", "op12_whitening")])
def test_queries_take_edge_rows(spark, tables, name):
    found = QUERIES[name](spark, tables)
    assert found.count() >= spark.read.parquet(f"{tables}/documents.parquet").count()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_agree_with_their_sql(spark, name):
    import duckdb

    folder = "/root/testdata/sf0.001"
    base = duckdb.connect()
    for table in ("documents", "conversations"):
        base.register(table, spark.read.parquet(f"{folder}/{table}.parquet").toArrow())
    found = QUERIES[name](spark, folder)
    columns = sorted(found.columns)
    expected = base.sql(ORACLE[name]).project(", ".join(columns)).fetchall()
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(expected)
