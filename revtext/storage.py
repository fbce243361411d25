"""Durable intermediate tables and scan layout."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Scratch tables of the job that is running, to be removed when it ends.
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master, where driver and executors are one machine, may fall
    back to a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    own = tempfile.mkdtemp(prefix="revtext-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def stage_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stage(
    df: DataFrame,
    label: str,
    path: str | None = None,
    partition_by: str | None = None,
    codec: str | None = None,
) -> DataFrame:
    """Write ``df`` as parquet and read it back.

    Cuts the lineage with a table that outlives lost executors; being
    columnar, later readers fetch only the columns they use.
    """
    if path is None:
        path = stage_path(df.sparkSession, label)
        if (made := _scratch.get()) is not None:
            made.append(path)
    writer = df.write.mode("overwrite")
    if codec:
        writer = writer.option("compression", codec)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _file_system(spark, path)
    return files.exists(at)


def is_finished(spark: SparkSession, path: str) -> bool:
    """Whether the table at ``path`` was written to its end."""
    return exists(spark, f"{path}/_SUCCESS")


def remove(spark: SparkSession, path: str) -> None:
    files, at = _file_system(spark, path)
    files.delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``stage`` stores inside without a path of their own are removed at the end.

    Results read later have to be stored under a path.
    """
    made: list[str] = []
    token = _scratch.set(made)
    try:
        yield
    finally:
        _scratch.reset(token)
        for path in made:
            remove(spark, path)


def releases_scratch(job: Callable) -> Callable:
    """A job whose first argument is a session or a frame, and whose results lie under its own paths."""

    @wraps(job)
    def run(first: SparkSession | DataFrame, *args, **options):
        with scratch(first if isinstance(first, SparkSession) else first.sparkSession):
            return job(first, *args, **options)

    return run


class Registry:
    """Tables kept under a folder by what they were made from, for jobs that run again.

    A table is found by its name, its parameters and the paths, sizes and times of its
    input files. Its manifest is written after it, so one that broke off is made anew, never read.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _key(self, name: str, inputs: Sequence[str], params: dict) -> tuple[str, dict]:
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(inputs))
        # Only the listing is read; the sum does not depend on its order.
        each = F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)")
        found = files.agg(F.count(F.lit(1)).alias("n"), F.sum(each).cast("string").alias("sum")).first()
        made_from = {"name": name, "params": params, "inputs": sorted(inputs), "files": found.n, "state": found.sum}
        return sha256(json.dumps(made_from, sort_keys=True).encode()).hexdigest()[:32], made_from

    def table(
        self, name: str, build: Callable[[], DataFrame], inputs: Sequence[str], **params
    ) -> tuple[DataFrame, bool]:
        """The table, and whether it was there already. ``params`` are plain values that ``build`` depends on."""
        key, made_from = self._key(name, inputs, params)
        data, manifest = f"{self.folder}/{name}-{key}/data", f"{self.folder}/{name}-{key}/manifest"
        if is_finished(self.spark, manifest):
            held = json.loads(self.spark.read.text(manifest).first().value)
            return self.spark.read.schema(StructType.fromJson(held["schema"])).parquet(data), True
        with scratch(self.spark):
            table = stage(build(), name, data)
        held = json.dumps(made_from | {"schema": table.schema.jsonValue()})
        row = self.spark.range(1).select(F.lit(held).alias("value"))
        row.coalesce(1).write.mode("overwrite").text(manifest)
        return table, False

    def release(self) -> None:
        """Remove every table of the folder."""
        remove(self.spark, self.folder)


def spread(scan: DataFrame, key: str | None = None) -> DataFrame:
    """Deal a scan over all cores, by ``key`` if given, but only when its splits are too few.

    Text work is CPU-bound, so one small file read by one task leaves the other
    cores idle. A large table already has more splits than cores and stays
    as it is, without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores, *([F.col(key)] if key else []))
