"""Counts of the words that can be among the most frequent, in two passes.

Counting every word sends every distinct word of every task through the
exchange, most of them once or twice seen. A first pass keeps a bounded number of
counters per task, with what they may have missed; the sums over all tasks bound
every word's count from below and above. Only words whose upper bound reaches the
k-th largest lower bound are counted exactly, in the second pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revtext.functions.bloom import BloomFilter
from revtext.operators.vocabulary import term_counts
from revtext.schemas import VOCAB_SIZE
from revtext.storage import stage

#: Counters a task keeps for each word asked for.
COUNTERS_PER_WORD = 4

_ROWS = "token string, low long, lost long"


def frequency_sketch(df: DataFrame, counters: int, tokens: str = "tokens") -> DataFrame:
    """``token, low, lost``: at most ``counters`` words of each task, and a row without token.

    ``low`` never exceeds the word's count in the task, and falls short of it by at most
    the ``lost`` of the task. When the counters run over, all give up the count of the
    first that has to go, which keeps the shortfall below rows / counters and lets
    sketches be added up (Misra and Gries 1982; Agarwal and others 2012).
    """

    def shrink(held: dict[str, int]) -> tuple[dict[str, int], int]:
        cut = sorted(held.values(), reverse=True)[counters]
        return {word: n - cut for word, n in held.items() if n > cut}, cut

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        lost = 0
        for batch in batches:
            counted = pc.value_counts(batch.column(0).flatten().drop_null())
            words, counts = counted.field(0).to_pylist(), counted.field(1).to_pylist()
            for word, n in zip(words, counts, strict=True):
                held[word] = held.get(word, 0) + n
            # Twice as many between cuts, so that a cut is not made for every batch.
            if len(held) > 2 * counters:
                held, cut = shrink(held)
                lost += cut
        if len(held) > counters:
            held, cut = shrink(held)
            lost += cut
        yield pa.record_batch(
            {
                "token": pa.array([*held, None], pa.string()),
                "low": pa.array([*held.values(), 0], pa.int64()),
                "lost": pa.array([0] * len(held) + [lost], pa.int64()),
            }
        )

    return df.select(tokens).mapInArrow(work, _ROWS)


def frequent_words(
    df: DataFrame, size: int = VOCAB_SIZE, counters: int | None = None, tokens: str = "tokens"
) -> DataFrame | None:
    """Words that can be among the ``size`` most frequent, none of them left out; None if unknown.

    The answer is unknown if words without a counter could be among them.
    """
    sketch = frequency_sketch(df, counters or COUNTERS_PER_WORD * size, tokens)
    merged = stage(sketch.groupBy("token").agg(F.sum("low").alias("low"), F.sum("lost").alias("lost")), "sketch")
    lost = merged.agg(F.sum("lost")).first()[0] or 0
    words = merged.where("token IS NOT NULL").select("token", "low")
    # A row per distinct count.
    falling = Window.orderBy(F.desc("low"))
    per_count = words.groupBy("low").agg(F.count(F.lit(1)).alias("words"))
    reached = per_count.select("low", F.sum("words").over(falling).alias("words"))
    least = reached.where(F.col("words") >= size).agg(F.max("low")).first()[0]
    if least is None:
        # Fewer words than asked for: all of them, if all were counted.
        return words.select("token") if not lost else None
    return words.where(F.col("low") + lost >= least).select("token") if lost < least else None


def frequent_counts(
    df: DataFrame, size: int = VOCAB_SIZE, counters: int | None = None, tokens: str = "tokens"
) -> DataFrame:
    """``token, n`` of a set of words that holds the ``size`` most frequent, counted exactly.

    Rank it with ``vocabulary``, which gives what it gives for all counts. ``df`` is read
    twice, so it should be stored. If the sketch is too coarse to tell, it is made
    again with four times the counters; if that is no better, all words are counted.
    """
    counters = counters or COUNTERS_PER_WORD * size
    for held in (counters, 4 * counters):
        candidates = frequent_words(df, size, held, tokens)
        if candidates is not None:
            break
    else:
        return term_counts(df, tokens)
    may_be = BloomFilter(candidates)
    words = df.select(F.explode_outer(tokens).alias("token")).where(F.col("token").isNotNull() & may_be.may_hold(F.col("token")))
    counted = words.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(candidates, "token", "left_semi")
