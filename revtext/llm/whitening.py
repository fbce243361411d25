"""Whitening of embeddings with covariances from exact variances.

The covariance of two dimensions is half of what the variance of their sum
exceeds their own variances by. So one kind of aggregate is enough: the sum of squares
of every dimension, and of every sum of two, each less a whole number near its mean.
Entries are whole numbers, so all sums are exact and do not depend on the order
in which tasks finish; only the finished covariance is rounded, once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revtext.storage import stage

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000

COMPONENTS = 8

#: Components with less than this share of the largest eigenvalue have no direction of
#: their own and are left out.
LEAST_SHARE = 1e-12

#: Rows of a block of vectors that is squared at once.
BLOCK = 1024

#: Exact sums of tasks, added up by Spark.
WIDE = pa.decimal128(38, 0)


@dataclass(frozen=True)
class Whitening:
    """What the fit list says: rows, sums, exact covariances and their leading components."""

    n: int
    sums: tuple[int, ...]
    covariance: np.ndarray
    eigenvalues: np.ndarray
    vectors: np.ndarray  # a column per component

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues / np.trace(self.covariance)


def fit_list(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, x``: the vectors without gaps as whole numbers, stored.

    Vectors that are null, empty or hold null or non-finite entries are dropped,
    and so are those of another length than most (the longest of equally many).
    """
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall(
        "v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    )
    x = F.transform("v", lambda c: (F.floor(c * SCALE) + SHIFT).cast("long"))
    whole = embeddings.select(F.col(id_col).alias("vec_id"), vector.alias("v"))
    whole = stage(whole.where((F.size("v") > 0) & finite).select("vec_id", x.alias("x")), "whitening-x")
    lengths = whole.groupBy(F.size("x").alias("length")).agg(F.count(F.lit(1)).alias("rows"))
    usual = lengths.orderBy(F.desc("rows"), F.desc("length")).first()
    return whole.where(F.size("x") == (usual.length if usual else 0))


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Blocks of at most ``BLOCK`` rows with their vectors as a matrix of longs."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            block = batch.slice(at, BLOCK)
            values = block.column("x").flatten().to_numpy(zero_copy_only=False)
            yield block, values.reshape(block.num_rows, -1)


def _exact(block: np.ndarray, times: int = 1) -> np.ndarray:
    """The block as it is if ``times`` its squares add up within a long, else as Python numbers."""
    most = int(np.abs(block).max(initial=0)) if block.dtype != object else max(map(abs, block.flat), default=0)
    fits = times * len(block) * most * most < 1 << 62
    return block if fits else block.astype(object)


def _sum_rows(totals: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
    yield pa.record_batch(
        {
            "i": pa.array([t[0] for t in totals], pa.int32()),
            "j": pa.array([t[1] for t in totals], pa.int32()),
            "total": pa.array([Decimal(int(t[2])) for t in totals], WIDE),
        }
    )


def _added(partial: DataFrame) -> dict[tuple[int, int], int]:
    """Totals of the tasks; a row per dimension or pair of them."""
    rows = partial.groupBy("i", "j").agg(F.sum("total").cast("decimal(38,0)").alias("total")).collect()
    return {(r.i, r.j): int(r.total) for r in rows}


SUMS = "i int, j int, total decimal(38,0)"


def _dimension_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Row count and exact sum of every dimension."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for block, x in _blocks(batches):
            n += block.num_rows
            # Squares within a long bound the plain sums too.
            part = _exact(x).sum(axis=0).astype(object)
            sums = part if sums is None else sums + part
        if n:
            yield from _sum_rows([(-1, -1, n), *((i, i, s) for i, s in enumerate(sums))])

    found = _added(rows.select("x").mapInArrow(work, SUMS))
    n = found.pop((-1, -1), 0)
    return n, [found[i, i] for i in range(len(found))]


def _square_sums(rows: DataFrame, centre: list[int]) -> dict[tuple[int, int], int]:
    """Exact sums of squares of x - centre, for every dimension (i, i) and sum of two (i, j)."""
    middle = np.array(centre, object)
    if all(abs(c) < 1 << 62 for c in centre):
        middle = middle.astype(np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, totals = len(centre), None
        for _, x in _blocks(batches):
            if totals is None:
                totals = np.zeros((size, size), object)
            d = _exact(x, 4) - middle
            d = _exact(np.ascontiguousarray(d.T).T, 4)
            for i in range(size):
                totals[i, i] += (d[:, i] ** 2).sum()
                if i + 1 < size:
                    both = d[:, i + 1 :] + d[:, i : i + 1]
                    totals[i, i + 1 :] += (both * both).sum(axis=0).astype(object)
        if totals is not None:
            yield from _sum_rows([(i, j, totals[i, j]) for i in range(size) for j in range(i, size)])

    return _added(rows.select("x").mapInArrow(work, SUMS))


def _covariance(n: int, sums: list[int], centre: list[int], squares: dict[tuple[int, int], int]) -> np.ndarray:
    """Covariances by polarisation, each worked out in whole numbers and rounded once."""
    size = len(sums)
    off = [s - n * c for s, c in zip(sums, centre, strict=True)]
    own = [n * squares[i, i] - off[i] ** 2 for i in range(size)]
    covariance = np.empty((size, size))
    for i in range(size):
        covariance[i, i] = own[i] / n**2
        for j in range(i + 1, size):
            of_sum = n * squares[i, j] - (off[i] + off[j]) ** 2
            covariance[i, j] = covariance[j, i] = (of_sum - own[i] - own[j]) / (2 * n**2)
    return covariance


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Components of the rows of ``fit_list``, by falling eigenvalue; None without rows.

    The driver holds a number per pair of dimensions. Components without variance
    are left out.
    """
    n, sums = _dimension_sums(rows)
    if not n:
        return None
    centre = [(2 * s + n) // (2 * n) for s in sums]
    covariance = _covariance(n, sums, centre, _square_sums(rows, centre))
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > LEAST_SHARE * max(values.max(), 0.0)]
    vectors = vectors[:, order]
    # One of both signs: the largest entry of a component is positive.
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
    return Whitening(n, tuple(sums), covariance, values[order], vectors * signs)


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """``vec_id, deviation, whitened``: exact distance from the mean and the whitened vector.

    ``deviation`` is the sum over dimensions of (n * x - sum) squared.
    """
    sums = np.array(model.sums, object)
    narrow = all(abs(s) < 1 << 61 for s in model.sums)
    project = model.vectors / np.sqrt(model.eigenvalues)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, x in _blocks(batches):
            most = int(np.abs(x).max(initial=0))
            if narrow and most * model.n < 1 << 61:
                centred = x * model.n - sums.astype(np.int64)
            else:
                centred = x.astype(object) * model.n - sums
            # Each row's own sum of squares has to fit.
            held = centred if len(model.sums) * int(np.abs(centred).max(initial=0)) ** 2 < 1 << 62 else centred.astype(object)
            deviation = (held * held).sum(axis=1)
            whitened = (centred.astype(np.float64) / model.n) @ project
            yield pa.record_batch(
                {
                    "vec_id": block.column("vec_id"),
                    "deviation": pa.array([Decimal(int(v)) for v in deviation], WIDE),
                    "whitened": pa.array(list(whitened), pa.list_(pa.float64())),
                }
            )

    id_type = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"vec_id {id_type}, deviation decimal(38,0), whitened array<double>")


def identity_error(whitened: DataFrame, components: int) -> float:
    """Largest absolute entry of the covariance of ``whitened`` less the identity, as measured."""
    entries = whitened.select(*(F.get("whitened", F.lit(k)).alias(f"w{k}") for k in range(components)))
    pairs = list(combinations_with_replacement(range(components), 2))
    found = entries.agg(*(F.covar_pop(f"w{a}", f"w{b}") for a, b in pairs)).first()
    return max(abs(c - (a == b)) for c, (a, b) in zip(found, pairs, strict=True))


def whitened_components(
    embeddings: DataFrame,
    components: int = COMPONENTS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``.

    A row per kept vector and component, numbered from 1 by falling eigenvalue.
    ``fit_list`` says which vectors are kept; null and repeated ids are rows like
    any other, and equal vectors count as often as they occur. With fewer
    dimensions, or fewer with variance, there are fewer components, none for a single
    vector or an empty table. Components of equal eigenvalues are any basis of their
    space. Entries beyond a long after scaling are an error; other columns are not read.
    """
    rows = fit_list(embeddings, id_col, vector_col)
    model = fit(rows, components)
    if model is None or not len(model.eigenvalues):
        empty = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
        none = embeddings.sparkSession.createDataFrame([], empty)
        return rows.select("vec_id").where("false").join(none)
    done = stage(whiten(rows, model), "whitened")
    error = identity_error(done, len(model.eigenvalues))
    explained = F.array(*(F.lit(float(e)) for e in model.explained))
    exploded = done.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return exploded.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
