"""Shared constants and schemas."""

from __future__ import annotations

# Sizes, fractions and seed of the encoded data sets.
MAX_LEN = 100
VOCAB_SIZE = 10_000
EVAL_FRACTION = 0.05
TEST_FRACTION = 0.05
SEED = 1234
SCORING_BATCH = 10_000

# Index 0 marks both padding and words outside the vocabulary.
PAD = 0
OOV = 0
FIRST_INDEX = 1

# Star ratings each label mode accepts.
BINARY_STARS = (1, 2, 4, 5)
MULTI_STARS = (1, 2, 3, 4, 5)


def check_classes(num_classes: int) -> int:
    if num_classes not in (2, 5):
        raise ValueError("num_classes must be 2 or 5")
    return num_classes


def wide_schema(width: int, keyed: bool, key_type: str = "bigint") -> str:
    """Schema of a flat CSV: an optional ``review_id``, then ``_1.._width``."""
    key = [f"review_id {key_type}"] if keyed else []
    return ", ".join(key + [f"_{i} bigint" for i in range(1, width + 1)])
