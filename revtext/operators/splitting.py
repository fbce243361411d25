"""Reproducible splits by a hash of the row key.

A row's part depends on its key alone, so it is the same at any number of
partitions and after any retry. A row without a key goes by all its values.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revtext.schemas import EVAL_FRACTION, SEED, TEST_FRACTION

#: Points a hash may fall on; a part takes a range of them.
POINTS = 1 << 60


def split_key(df: DataFrame, key: str = "review_id") -> Column:
    """What a row's part depends on: its key, or all its values where the key is null."""
    values = F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))
    return F.coalesce(F.col(key).cast("string"), F.concat(F.lit("null:"), values.cast("string")))


def point(key: Column, seed: int = SEED, use: str = "split") -> Column:
    """Point of a key, 0 to ``POINTS`` - 1; another ``use`` gives independent points."""
    digest = F.md5(F.concat_ws(":", F.lit(use), F.lit(str(seed)), key.cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _first(*held_back: float | None) -> int:
    """The first point behind those that are not held back."""
    parts = [Fraction(str(f or 0)) for f in held_back]
    if min(parts) < 0 or sum(parts) > 1:
        raise ValueError("fractions lie between 0 and 1, and so does their sum")
    return int((1 - sum(parts)) * POINTS)


def part_of(
    key: Column,
    test: float | None = TEST_FRACTION,
    evaluation: float = EVAL_FRACTION,
    seed: int = SEED,
) -> Column:
    """``train``, ``eval`` or ``test``: the part a key falls into."""
    first_eval, first_test = _first(test, evaluation), _first(test)
    at = point(key, seed)
    return F.when(at < first_eval, "train").when(at < first_test, "eval").otherwise("test")


def split_test(
    df: DataFrame,
    test: float | None = TEST_FRACTION,
    seed: int = SEED,
    key: str = "review_id",
    hashed: bool = True,
) -> tuple[DataFrame, DataFrame | None]:
    """Rows to work on and rows held out; no hold-out when ``test`` is None.

    ``hashed=False`` draws the parts at random, which needs no key but gives
    other parts at another partitioning; so it does in the functions below.
    """
    if test is None:
        return df, None
    if not hashed:
        work, held_out = df.randomSplit([1 - test, test], seed)
        return work, held_out
    held_out = point(split_key(df, key), seed) >= _first(test)
    return df.where(~held_out), df.where(held_out)


def split_train_eval(
    df: DataFrame,
    test: float | None = TEST_FRACTION,
    evaluation: float = EVAL_FRACTION,
    seed: int = SEED,
    key: str = "review_id",
    hashed: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Training and evaluation rows among those not held out."""
    if not hashed:
        train, held_back = df.randomSplit([1 - (test or 0) - evaluation, evaluation], seed)
        return train, held_back
    in_eval = point(split_key(df, key), seed) >= _first(test, evaluation)
    return df.where(~in_eval), df.where(in_eval)


def sample_rows(
    df: DataFrame,
    fraction: float,
    seed: int = SEED,
    key: str = "review_id",
    hashed: bool = True,
) -> DataFrame:
    """Bernoulli sample without replacement, independent of the splits."""
    if not hashed:
        return df.sample(False, fraction, seed)
    return df.where(point(split_key(df, key), seed, "sample") < POINTS - _first(fraction))
