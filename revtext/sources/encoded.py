"""Encoded reviews from flat CSV files or parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revtext.schemas import MAX_LEN, check_classes, wide_schema
from revtext.storage import stage

#: Input splits whose row numbers are sent to every task, about 100 bytes each.
BROADCAST_SPLITS = 500_000


def _array(first: int, last: int) -> Column:
    return F.array(*[F.col(f"_{i}").cast("int") for i in range(first, last + 1)])


def _read_wide(
    spark: SparkSession, path: str, width: int, keyed: bool, header: bool, key_type: str
) -> DataFrame:
    schema = wide_schema(width, keyed, key_type)
    return spark.read.schema(schema).csv(path, sep=",", header=header)


def read_encoded_csv(
    spark: SparkSession,
    path: str,
    num_classes: int = 5,
    length: int = MAX_LEN,
    keyed: bool = False,
    header: bool = False,
    key_type: str = "bigint",
) -> DataFrame:
    """One CSV of ``length`` index columns, then the one-hot label columns."""
    width = length + check_classes(num_classes)
    wide = _read_wide(spark, path, width, keyed, header, key_type)
    key = ["review_id"] if keyed else []
    return wide.select(
        *key,
        _array(1, length).alias("features"),
        _array(length + 1, width).alias("label_ohe"),
    )


def read_xy_csv(
    spark: SparkSession,
    x_path: str,
    y_path: str,
    num_classes: int = 5,
    length: int = MAX_LEN,
    keyed: bool = True,
    header: bool = False,
    key_type: str = "bigint",
) -> DataFrame:
    """Features and labels from two CSVs, paired by ``review_id``.

    Files without a key column pair their rows by line number instead.
    """
    x = _read_wide(spark, x_path, length, keyed, header, key_type)
    y = _read_wide(spark, y_path, check_classes(num_classes), keyed, header, key_type)
    key = "review_id"
    if not keyed:
        key = "line"
        x, y = with_line_number(x, key), with_line_number(y, key)
    x = x.select(key, _array(1, length).alias("features"))
    y = y.select(key, _array(1, num_classes).alias("label_ohe"))
    return x.join(y, key)


def with_line_number(scan: DataFrame, name: str = "line") -> DataFrame:
    """Number the rows of a file scan in file order, from 0.

    Rows are numbered within each input split; only one row per split is
    counted up globally, so no task sees more than the splits' sizes. These
    are broadcast, unless there are over ``BROADCAST_SPLITS``.
    """
    order = Window.orderBy("path", "start")
    numbered = scan.select(
        "*",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("serial"),
    )
    splits = numbered.groupBy("path", "start").agg(
        F.count(F.lit(1)).alias("rows"), F.min("serial").alias("first")
    )
    splits = stage(splits, "splits")
    few = splits.count() <= BROADCAST_SPLITS
    offsets = splits.select(
        "path",
        "start",
        "first",
        (F.sum("rows").over(order) - F.col("rows")).alias("offset"),
    )
    line = F.col("offset") + F.col("serial") - F.col("first")
    offsets = F.broadcast(offsets) if few else offsets
    return numbered.join(offsets, ["path", "start"]).select(
        *[F.col(c) for c in scan.columns], line.alias(name)
    )
