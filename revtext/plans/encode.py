"""From reviews to encoded reviews."""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revtext.functions.cleaning import clean_text
from revtext.functions.labels import keep_labelled, one_hot
from revtext.functions.lemma import VerbLemmatizer
from revtext.functions.tokens import (
    STOP_WORDS,
    drop_empty_tokens,
    remove_stop_words,
    strip_punctuation,
    tokenize,
)
from revtext.operators.abbreviations import tokenize_learned
from revtext.operators.vocabulary import encode_tokens, term_counts, vocabulary
from revtext.schemas import MAX_LEN, VOCAB_SIZE
from revtext.storage import stage


@lru_cache(maxsize=1)
def _seed_lemmatizer() -> VerbLemmatizer:
    return VerbLemmatizer()


def word_tokens(
    text: Column,
    stop_words: Iterable[str] = STOP_WORDS,
    lemmatizer: VerbLemmatizer | None = None,
) -> Column:
    """Clean text to word tokens: split, stop words, punctuation, lemmas."""
    return finish_tokens(tokenize(clean_text(text)), stop_words, lemmatizer)


def finish_tokens(
    tokens: Column,
    stop_words: Iterable[str] = STOP_WORDS,
    lemmatizer: VerbLemmatizer | None = None,
) -> Column:
    """Stop words, which go while punctuation is still attached, then punctuation and lemmas."""
    words = drop_empty_tokens(strip_punctuation(remove_stop_words(tokens, stop_words)))
    return (lemmatizer or _seed_lemmatizer()).lemmas(words)


@lru_cache(maxsize=4)
def _default_word_tokens(column: str) -> Column:
    return word_tokens(F.col(column))


def review_tokens(
    reviews: DataFrame,
    stop_words: Iterable[str] = STOP_WORDS,
    lemmatizer: VerbLemmatizer | None = None,
    abbreviations: DataFrame | None = None,
) -> DataFrame:
    """``review_id``, ``star_rating`` and ``part`` where there are any, and ``tokens``.

    Words of a table of ``abbreviations`` keep their period until punctuation goes, and
    so are no stop words.
    """
    kept = [c for c in ("review_id", "star_rating", "part") if c in reviews.columns]
    if abbreviations is not None:
        text = clean_text(F.col("review_body"))
        split = tokenize_learned(reviews.select(*kept, "review_body"), abbreviations, text, "tokens")
        return split.select(*kept, finish_tokens(F.col("tokens"), stop_words, lemmatizer).alias("tokens"))
    if lemmatizer is None and stop_words is STOP_WORDS:
        tokens = _default_word_tokens("review_body")
    else:
        tokens = word_tokens(F.col("review_body"), stop_words, lemmatizer)
    return reviews.select(*kept, tokens.alias("tokens"))


def build_vocabulary(
    tokens: DataFrame, size: int = VOCAB_SIZE, path: str | None = None
) -> DataFrame:
    """The vocabulary as a stored table, so later plans do not count again."""
    return stage(vocabulary(term_counts(tokens), size), "vocab", path)


def add_label(encoded: DataFrame, num_classes: int) -> DataFrame:
    return encoded.withColumn("label_ohe", one_hot(F.col("star_rating"), num_classes))


def encode_reviews(
    reviews: DataFrame,
    num_classes: int = 5,
    vocab: DataFrame | None = None,
    max_len: int = MAX_LEN,
    vocab_size: int = VOCAB_SIZE,
    stop_words: Iterable[str] = STOP_WORDS,
    lemmatizer: VerbLemmatizer | None = None,
    tokens_path: str | None = None,
    abbreviations: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Encode labelled reviews with ``vocab``, or with one built from them.

    Returns ``(review_id, star_rating, features, label_ohe)`` and the
    vocabulary. With a given vocabulary this is one map-only stage. Building
    one reads the tokens twice, so they are stored in between.
    """
    tokens = review_tokens(keep_labelled(reviews, num_classes), stop_words, lemmatizer, abbreviations)
    if vocab is None:
        tokens = stage(tokens, "tokens", tokens_path)
        vocab = build_vocabulary(tokens, vocab_size)
    encoded = encode_tokens(tokens, vocab, max_len)
    columns = ["review_id", "star_rating", "features"]
    return add_label(encoded.select(*columns), num_classes), vocab
