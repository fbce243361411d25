"""Review-text encoding and classification as Spark DataFrame jobs."""

from revtext.plans.encode import encode_reviews, review_tokens
from revtext.plans.incremental import prepare_incremental
from revtext.plans.jobs import evaluate, evaluate_raw, predict, prepare, train

__all__ = [
    "encode_reviews",
    "evaluate",
    "evaluate_raw",
    "predict",
    "prepare",
    "prepare_incremental",
    "review_tokens",
    "train",
]
