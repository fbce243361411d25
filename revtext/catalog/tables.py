"""Reviews and texts drawn from the shared tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revtext.storage import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    scan = table(spark, folder, "documents").select("doc_id", "text")
    return spread(scan, "doc_id")


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as reviews; their labels give the stars, 3 without a label."""
    labels = table(spark, folder, "labels")
    clean = F.col("toxic") == 0
    star = (
        F.when(F.col("quality").isNull(), 3)
        .when((F.col("quality") == 1) & clean, 5)
        .when(F.col("quality") == 1, 4)
        .when(clean, 2)
        .otherwise(1)
    )
    return documents(spark, folder).join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("review_id"),
        F.col("text").alias("review_body"),
        star.alias("star_rating"),
    )


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every text of the shared tables: ``(kind, id, part, text)``."""
    parts = [
        ("document", "documents", "doc_id", F.lit(0), "text"),
        ("page", "pages", "page_id", F.lit(0), "html"),
        ("turn", "conversations", "conv_id", F.col("turn"), "text"),
        ("item", "benchmark", "item_id", F.lit(0), "text"),
    ]
    return reduce(
        DataFrame.unionByName,
        (
            spread(table(spark, folder, name), key).select(
                F.lit(kind).alias("kind"),
                F.col(key).alias("id"),
                part.cast("long").alias("part"),
                F.col(body).alias("text"),
            )
            for kind, name, key, part, body in parts
        ),
    )
