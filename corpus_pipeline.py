"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir), works on all rows the one before it
kept, and returns the columns of ``documents``; the last returns the packed
pieces. Null ids, texts, languages and sources, repeated rows and empty tables
pass through as the operators define it; further columns are kept up to the
last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revtext.llm import compression, mixing, packing, pii, simhash
from revtext.storage import stage

SCORE, GOOD = "_quality_score", "_quality_good"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = compression.fit(docs, labels)
    scored = compression.classify(docs, model, score_col=SCORE, predicted_col=GOOD)
    return scored.where(F.col(GOOD) == 1).drop(SCORE, GOOD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by the name of its kind."""
    return pii.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources come near their weights."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, cut into pieces and packed into sequences."""
    return packing.placements(packing.pack(docs), ids=True)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix", mix),
    ("pack", pack),
]

#: Trained scores, fingerprints and token ids can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
