"""Abbreviations learned from the text itself, so that sentences end where they should.

A word is an abbreviation if it goes with its final period far more often than
words do. The log-likelihood ratio of that is weighted as published (Kiss and
Strunk 2006): short words and words with inner periods gain, words also
seen without the period lose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revtext.functions.abbreviations import PIECE, pieces, words_before_period
from revtext.functions.lookup import Lookup, small_table
from revtext.functions.tokens import tokenize
from revtext.storage import stage

# Fixed values of the published method.
PERIOD_SHARE = 0.99
LEAST_SCORE = 0.3


def word_periods(df: DataFrame, text: str = "text") -> DataFrame:
    """``word, n_final, n_plain``: how often each word has a period behind it, and has none."""
    piece = df.select(F.explode(pieces(F.col(text))).alias("piece"))
    # Counted before they are taken apart, so that each distinct piece is searched once. The word hangs
    # on the count, as a filter of it would sink below the count otherwise, and the search with it.
    counted = piece.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    split = counted.select(
        F.when(F.col("n") > 0, F.regexp_extract("piece", PIECE, 1)).alias("word"),
        (F.regexp_extract("piece", PIECE, 2) == ".").cast("long").alias("final"),
        "n",
    )
    words = split.where("word <> ''").groupBy("word")
    return words.agg(
        F.sum(F.col("final") * F.col("n")).alias("n_final"), F.sum((1 - F.col("final")) * F.col("n")).alias("n_plain")
    )


def abbreviation_scores(counts: DataFrame) -> DataFrame:
    """Add ``score`` to each word of ``word_periods`` seen with a final period."""
    # Of all words; one row.
    total = counts.agg(F.sum("n_final").alias("f"), F.sum("n_plain").alias("p")).first()
    finals, words = total.f or 0, max((total.f or 0) + (total.p or 0), 1)
    share = min(max(finals / words, 1e-12), 1 - 1e-12)
    with_period, without = F.col("n_final"), F.col("n_plain")

    def likelihood(p: float) -> Column:
        return with_period * F.log(F.lit(p)) + without * F.log(F.lit(1 - p))

    ratio = -2 * (likelihood(share) - likelihood(PERIOD_SHARE))
    letters = F.length(F.replace("word", F.lit("."), F.lit("")))
    periods = F.length("word") - letters + 1
    weight = F.exp(-letters) * periods * F.pow(letters.cast("double"), -without)
    return counts.where("n_final > 0").select("word", "n_final", "n_plain", (ratio * weight).alias("score"))


def learn_abbreviations(
    df: DataFrame, text: str = "text", least: float | None = LEAST_SCORE, path: str | None = None
) -> DataFrame:
    """Abbreviations of cleaned texts with their scores, stored; all candidates if ``least`` is None."""
    scored = abbreviation_scores(stage(word_periods(df, text), "word-periods"))
    if least is not None:
        scored = scored.where(F.col("score") >= least)
    return stage(scored, "abbreviations", path)


def tokenize_learned(
    df: DataFrame, abbreviations: DataFrame, text: Column, tokens: str = "tokens"
) -> DataFrame:
    """Add ``tokens`` of the cleaned ``text``; words of ``abbreviations`` keep their period inside it.

    A table small enough is a constant of the plan. A larger one is joined with the
    distinct words before a period of each row, and the text work follows the join.
    """
    words = abbreviations.select("word").distinct()
    small = small_table(words)
    if small is not None:
        lookup = Lookup({row.word: True for row in small}, "boolean")
        return df.withColumn(tokens, tokenize(text, lookup.get if small else None))
    columns = df.columns
    rows = stage(df.select("*", text.alias("_text")).withColumn("_row", F.monotonically_increasing_id()), "texts")
    met = rows.select("_row", F.explode(words_before_period(F.col("_text"))).alias("word"))
    found = met.join(words, "word").groupBy("_row").agg(F.collect_list("word").alias("_known"))
    joined = rows.join(found, "_row", "left")
    kept = tokenize(F.col("_text"), lambda w: F.array_contains("_known", w))
    return joined.select(*(F.col(c) for c in columns), kept.alias(tokens))
