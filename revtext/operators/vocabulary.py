"""Term counts, the top-k vocabulary and word indices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revtext.functions.arrays import has_known_word, pad_trim
from revtext.functions.bloom import BloomFilter
from revtext.functions.lookup import MAX_ENTRIES, Lookup, small_table
from revtext.schemas import FIRST_INDEX, MAX_LEN, OOV, SEED, VOCAB_SIZE
from revtext.storage import stage

# Words of a sample of the rows that a shuffled index join looks up in place, as they
# may be frequent here whatever their rank in the dictionary.
HOT_WORDS = 1000
HOT_SAMPLE = 0.02
MAX_HOT_LENGTH = 200


def term_counts(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Occurrences of each word; counted per partition before the shuffle."""
    # A plain explode makes Catalyst test the size of the array first, and so
    # compute it twice when it is an expression.
    words = df.select(F.explode_outer(tokens).alias("token")).where("token IS NOT NULL")
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(counts: DataFrame, size: int = VOCAB_SIZE, stored: bool = False) -> DataFrame:
    """The ``size`` most frequent words with indices 1, 2, ... by rank.

    ``counts`` is read more than once, so it is stored first unless it is ``stored`` already.

    Equal counts are ordered by word, so indices do not depend on how the
    data is partitioned. A histogram of the counts gives the least count that
    can be needed; only words that reach it are dealt by range and ranked
    within their range, behind the sizes of the ranges before. One task sees a
    row per distinct count, and a row per range.
    """
    counts = counts if stored else stage(counts, "term-counts")
    per_count = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    falling = Window.orderBy(F.desc("n"))
    reached = per_count.select("n", (F.sum("words").over(falling) - F.col("words")).alias("before"))
    least = reached.where(F.col("before") < size).agg(F.min("n")).first()[0]
    order = (F.desc("n"), F.asc("token"))
    kept = counts.where(F.col("n") >= F.lit(least)).repartitionByRange(*order)
    kept = stage(kept.withColumn("range", F.spark_partition_id()), "ranges")
    sizes = kept.groupBy("range").agg(F.count(F.lit(1)).alias("words"))
    ahead = F.sum("words").over(Window.orderBy("range")) - F.col("words")
    # As many rows as the range exchange had partitions.
    ahead = F.broadcast(sizes.select("range", ahead.alias("ahead")))
    rank = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    ranked = kept.withColumn("rank", rank).join(ahead, "range")
    idx = (F.col("ahead") + F.col("rank") + (FIRST_INDEX - 1)).cast("int")
    return ranked.select("token", "n", idx.alias("idx")).where(F.col("idx") < size + FIRST_INDEX)


def vocabulary_lookup(vocab: DataFrame) -> Lookup | None:
    """The dictionary as a constant, or None when it is too large for one."""
    rows = small_table(vocab.select("token", "idx"))
    return None if rows is None else Lookup({row.token: row.idx for row in rows}, "int")


def word_index(lookup: Lookup, word: Column) -> Column:
    return F.coalesce(lookup.get(word), F.lit(OOV))


def index_tokens(df: DataFrame, vocab: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Add ``idx``: every word's index, order kept, 0 for unknown words."""
    lookup = vocabulary_lookup(vocab)
    if lookup is None:
        return index_by_join(df, vocab, tokens)
    return df.withColumn("idx", F.transform(tokens, lambda t: word_index(lookup, t)))


def encode_tokens(
    df: DataFrame, vocab: DataFrame, length: int = MAX_LEN, tokens: str = "tokens"
) -> DataFrame:
    """Add ``features``, dropping rows without any known word."""
    indexed, features, known = _features(df, vocab, length, tokens)
    # A filter on ``known`` would sink below the tokens and so compute them a
    # second time; a generator's output stays above them.
    kept = F.explode_outer(F.when(known, F.array(features)))
    columns = [F.col(c) for c in df.columns]
    return indexed.select(*columns, kept.alias("features")).where("features IS NOT NULL")


def flag_tokens(
    df: DataFrame, vocab: DataFrame, length: int = MAX_LEN, tokens: str = "tokens"
) -> DataFrame:
    """Add ``features`` and ``known``: whether any word of the row has an index."""
    indexed, features, known = _features(df, vocab, length, tokens)
    columns = [F.col(c) for c in df.columns]
    return indexed.select(*columns, features.alias("features"), known.alias("known"))


def _features(
    df: DataFrame, vocab: DataFrame, length: int, tokens: str
) -> tuple[DataFrame, Column, Column]:
    """A frame and the columns to take from it: indices and the known flag.

    All words of a row decide, also those past the first ``length``; the test
    ends at the first known one.
    """
    lookup = vocabulary_lookup(vocab)
    if lookup is None:
        idx = F.col("idx")
        known = F.coalesce(has_known_word(idx), F.lit(False))
        return index_by_join(df, vocab, tokens), pad_trim(idx, length), known
    head = F.transform(F.slice(tokens, 1, length), lambda t: word_index(lookup, t))
    known = F.coalesce(F.exists(tokens, lambda t: word_index(lookup, t) > OOV), F.lit(False))
    return df, pad_trim(head, length), known


def index_by_join(
    df: DataFrame,
    vocab: DataFrame,
    tokens: str = "tokens",
    head: int | None = None,
) -> DataFrame:
    """Index words by dictionaries of any size.

    Rows are stored with a number of their own first, so that the text work is
    done once and keys may be null, repeated or missing. The ``head`` lowest
    indices, which belong to the most frequent words, are still looked up in place, and so are
    the most frequent other words of a sample of the rows, known or not. Words that a
    Bloom filter of the rest of the dictionary rules out never move; only the
    others are joined, and only those the join finds are brought back.
    """
    head, key, columns = MAX_ENTRIES if head is None else head, "_row", df.columns
    df = stage(df.withColumn(key, F.monotonically_increasing_id()), "numbered")
    in_head = F.col("idx") <= head
    frequent = small_table(vocab.where(in_head).select("token", "idx"))
    if frequent is None:
        raise ValueError("the words looked up in place must fit a constant; lower head")
    in_place_words = {row.token: row.idx for row in frequent}
    entries = vocab.where(~in_head).select("token", (-F.col("idx")).alias("neg"))
    may_hold = BloomFilter(entries).may_hold
    words = df.select(key, F.posexplode_outer(tokens).alias("pos", "token")).where("token IS NOT NULL")
    in_place_words |= _hot_words(df, entries, Lookup(in_place_words, "int"), may_hold, tokens)
    lookup = Lookup(in_place_words, "int")
    # Negated, so that sorting puts an index before the 0 of its position.
    in_place = F.transform(
        tokens, lambda t, pos: F.struct(pos.alias("pos"), (-word_index(lookup, t)).alias("neg"))
    )
    rest = words.where(lookup.get(F.col("token")).isNull() & may_hold(F.col("token")))
    joined = rest.join(entries, "token")
    found = joined.groupBy(key).agg(F.collect_list(F.struct("pos", "neg")).alias("found"))

    none = F.array().cast("array<struct<pos:int,neg:int>>")
    at = F.sort_array(F.concat(in_place, F.coalesce("found", none)))
    merged = df.join(found, key, "left").withColumn("found", at)
    first = F.filter(
        "found",
        lambda x, i: (i == 0) | (F.get("found", i - 1)["pos"] != x["pos"]),
    )
    idx = F.transform(first, lambda x: -x["neg"])
    return merged.select(*[F.col(c) for c in columns], idx.alias("idx"))


def _hot_words(
    df: DataFrame,
    entries: DataFrame,
    in_place: Lookup,
    may_hold: Callable[[Column], Column],
    tokens: str,
) -> dict[str, int]:
    """Index, 0 for none, of the most frequent words of a sample that would go through the join."""
    words = df.sample(False, HOT_SAMPLE, SEED).select(F.explode(tokens).alias("token"))
    moving = words.where(in_place.get(F.col("token")).isNull() & may_hold(F.col("token")))
    short = moving.where(F.length("token") <= MAX_HOT_LENGTH)
    counted = short.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    hot = stage(counted.orderBy(F.desc("n"), "token").limit(HOT_WORDS), "hot-words")
    found = F.broadcast(hot).join(entries, "token", "left")
    return {row.token: -row.neg for row in found.select("token", F.coalesce("neg", F.lit(0)).alias("neg")).collect()}
