"""Fixed-length index sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revtext.schemas import MAX_LEN, PAD, VOCAB_SIZE


def pad_trim(idx: Column, length: int = MAX_LEN) -> Column:
    """First ``length`` entries, padded on the right."""
    return F.slice(F.concat(idx, F.array_repeat(F.lit(PAD), length)), 1, length)


def has_known_word(idx: Column) -> Column:
    return F.exists(idx, lambda i: i > 0)


def index_sum(idx: Column) -> Column:
    return F.aggregate(idx, F.lit(0).cast("long"), lambda acc, i: acc + i)


def normalize(idx: Column, vocab_size: int = VOCAB_SIZE) -> Column:
    """Indices scaled by the vocabulary size, as floats."""
    size = F.lit(float(vocab_size)).cast("float")
    return F.transform(idx, lambda i: (i.cast("float") / size).cast("float"))


def flat_row(features: Column, label: Column) -> Column:
    return F.concat(features, label)


def split_features(row: Column, num_classes: int) -> Column:
    """All but the last ``num_classes`` entries, as floats."""
    return F.slice(row, F.lit(1), F.size(row) - num_classes).cast("array<float>")


def split_labels(row: Column, num_classes: int) -> Column:
    """The last ``num_classes`` entries, as ints."""
    start = F.size(row) - (num_classes - 1)
    return F.slice(row, start, F.lit(num_classes)).cast("array<int>")
