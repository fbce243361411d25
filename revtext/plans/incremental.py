"""New reviews added to a finished preparation, without tokenising the old ones again."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revtext.functions.bloom import BloomFilter
from revtext.functions.labels import keep_labelled
from revtext.functions.lemma import VerbLemmatizer
from revtext.functions.lookup import Lookup, constant_array, small_table
from revtext.functions.tokens import STOP_WORDS
from revtext.operators.splitting import part_of, split_key, split_test
from revtext.operators.vocabulary import encode_tokens, term_counts, vocabulary
from revtext.plans.encode import add_label, review_tokens
from revtext.plans.jobs import Prepared, Settings
from revtext.schemas import OOV
from revtext.sinks.datasets import write_dictionary
from revtext.storage import releases_scratch, stage

PARTS = ("train", "eval")

#: Words of a vocabulary whose moves fit a constant; rows of a larger one are encoded from their tokens.
MAX_MOVES = 1_000_000


def merged_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Term counts of two sets of rows from the counts of either."""
    return old.unionByName(new).groupBy("token").agg(F.sum("n").alias("n"))


def index_moves(old: DataFrame, new: DataFrame) -> DataFrame:
    """``idx, moved``: the new index of every old one, 0 for words that left the vocabulary."""
    now = new.select("token", F.col("idx").alias("moved"))
    joined = old.select("token", "idx").join(now, "token", "left")
    return joined.select("idx", F.coalesce("moved", F.lit(OOV)).alias("moved"))


def move_features(moves: DataFrame, features: Column) -> Column:
    """Features under the new vocabulary, from those under the old one.

    The map has an entry per word of the vocabulary that features were made with.
    """
    rows = moves.collect()
    table = [OOV] * (1 + max((r.idx for r in rows), default=0))
    for row in rows:
        table[row.idx] = row.moved
    to = constant_array(table, "int")
    return F.transform(features, lambda i: F.get(to, i))


def holds_any(words: DataFrame, tokens: str = "tokens") -> Column:
    """Whether a row holds one of the words; of a table too large for a constant, whether it may."""
    small = small_table(words.select("token"))
    if small is None:
        may_hold = BloomFilter(words).may_hold
        return F.exists(tokens, may_hold)
    known = Lookup({row.token: True for row in small}, "boolean")
    return F.exists(tokens, lambda t: F.coalesce(known.get(t), F.lit(False)))


def _again(tokens: DataFrame, encoded: DataFrame, entering: DataFrame, moved: Column) -> DataFrame:
    """``review_id`` of old rows that the index map can't serve; null ids always are.

    They hold a word that is new to the vocabulary, or lost every word among the first ones and
    may have another behind.
    """
    lost = F.forall(moved, lambda i: i == OOV)
    holding = tokens.where(F.coalesce(holds_any(entering), F.lit(False)) | F.col("review_id").isNull())
    return holding.select("review_id").union(encoded.where(lost).select("review_id")).distinct()


@releases_scratch
def prepare_incremental(
    spark: SparkSession,
    before: str,
    reviews: DataFrame,
    out: str,
    stop_words: Iterable[str] = STOP_WORDS,
    lemmatizer: VerbLemmatizer | None = None,
) -> Prepared:
    """What ``prepare`` gives for the old and new reviews together, from its folder ``before`` and the new ones.

    Counts of the new reviews are added to the stored counts, and the vocabulary is ranked anew. Old rows go
    through a map of indices; only rows that hold a word that just entered the vocabulary are
    encoded from their stored tokens. The old reviews are not read. ``reviews`` needs a
    ``review_id``; ids that occur on both sides stay separate rows. The settings are those of
    ``before``, learned abbreviations included; give the stop words and lemmatizer it was given. The
    new folder refers to the token tables of the old one, which has to stay.
    """
    settings = Settings.read(spark, before)
    if "review_id" not in reviews.columns:
        raise ValueError("new reviews need a review_id")
    table = {name: spark.read.parquet(f"{before}/{name}") for name in ("counts", "vocab", *PARTS)}
    abbreviations = spark.read.parquet(*settings.abbreviations) if settings.abbreviations else None

    labelled = keep_labelled(reviews, settings.num_classes)
    work, held_out = split_test(labelled, settings.test, settings.seed)
    part = part_of(split_key(work), settings.test, settings.evaluation, settings.seed)
    new_tokens = stage(
        review_tokens(work.withColumn("part", part), stop_words, lemmatizer, abbreviations),
        "tokens",
        f"{out}/tokens",
        partition_by="part",
    )
    fit_rows = new_tokens.where("part = 'train'") if settings.vocab_from_train_only else new_tokens
    counts = stage(merged_counts(table["counts"], term_counts(fit_rows)), "counts", f"{out}/counts")
    vocab = stage(vocabulary(counts, settings.vocab_size, stored=True), "vocab", f"{out}/vocab")
    entering = vocab.join(table["vocab"].select("token"), "token", "left_anti")

    token_tables = (spark.read.schema(new_tokens.schema).parquet(path) for path in settings.tokens)
    old_tokens = reduce(DataFrame.unionByName, token_tables)
    columns = ["review_id", "star_rating", "part", "features"]
    if settings.vocab_size <= MAX_MOVES:
        moved = move_features(index_moves(table["vocab"], vocab), F.col("features"))
        old = table["train"].withColumn("part", F.lit("train"))
        old = old.unionByName(table["eval"].withColumn("part", F.lit("eval")))
        again = stage(_again(old_tokens, old, entering, moved), "encode-again")
        same_id = F.col("kept.review_id").eqNullSafe(F.col("again.review_id"))
        kept = old.alias("kept").join(again.alias("again"), same_id, "left_anti").withColumn("features", moved)
        from_tokens = old_tokens.alias("kept").join(again.alias("again"), same_id, "left_semi")
    else:
        kept, from_tokens = None, old_tokens
    fresh = encode_tokens(from_tokens.unionByName(new_tokens), vocab, settings.max_len).select(*columns)
    rows = fresh if kept is None else kept.select(*columns).unionByName(fresh)
    encoded = add_label(rows, settings.num_classes)

    train, evaluation = (
        stage(encoded.where(F.col("part") == name).drop("part"), name, f"{out}/{name}") for name in PARTS
    )
    write_dictionary(vocab, f"{out}/dictionary")
    if held_out is not None:
        old_test = spark.read.parquet(f"{before}/test")
        held_out = stage(old_test.unionByName(held_out, allowMissingColumns=True), "test", f"{out}/test")
    replace(settings, tokens=[*settings.tokens, f"{out}/tokens"]).write(spark, out)
    return Prepared(
        train, evaluation, held_out, vocab, settings.num_classes, settings.vocab_size, None, abbreviations
    )
