"""Batches of whole texts for the operators that run numpy inside Spark tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of a batch that an operator works on at once, and the bytes that close it before that.
BATCH_ROWS = 500
BATCH_BYTES = 2 << 20

BYTES_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def sliced(
    batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS, size: int = BATCH_BYTES
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, and of ``size`` bytes unless one row is longer."""
    for batch in batches:
        parts = max(1, -(-batch.nbytes // size))
        step = max(1, min(rows, -(-batch.num_rows // parts)))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            if part.nbytes > size and part.num_rows > 1:
                yield from sliced([part], -(-part.num_rows // 2), size)
            else:
                yield part


def joined(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that end at ``size`` bytes or with the row batch that passes them."""
    held, held_bytes = [], 0
    for batch in batches:
        held.append(batch)
        held_bytes += batch.nbytes
        if held_bytes >= size:
            yield pa.concat_batches(held)
            held, held_bytes = [], 0
    if held:
        yield pa.concat_batches(held)


def _bytes(setting: str) -> int:
    """A size as Spark writes it: digits and a unit."""
    digits = setting.rstrip("bkmgtBKMGT")
    unit = setting[len(digits) :].lower().rstrip("b")
    return int(digits) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


def map_batches(
    df: DataFrame,
    work: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]],
    schema: str,
    rows: int = BATCH_ROWS,
) -> DataFrame:
    """``df.mapInArrow`` over batches small enough for very long texts.

    Only the bytes of Spark's own batches are bounded in the session, as a lazy plan reads the
    setting when it runs; their rows stay as set, and the worker cuts batches further.
    """
    conf = df.sparkSession.conf
    if not 0 < _bytes(conf.get(BYTES_SETTING)) <= BATCH_BYTES:
        conf.set(BYTES_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(lambda batches: work(sliced(batches, rows)), schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """The texts, null as empty."""
    return [x or "" for x in column.to_pylist()]
