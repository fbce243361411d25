"""Label domains, one-hot labels and class names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revtext.schemas import BINARY_STARS, MULTI_STARS, check_classes


def keep_labelled(df: DataFrame, num_classes: int, star: str = "star_rating") -> DataFrame:
    """Rows whose rating the label mode accepts; null and other values go."""
    stars = BINARY_STARS if check_classes(num_classes) == 2 else MULTI_STARS
    return df.where(F.col(star).isin(*stars))


def one_hot_multi(star: Column) -> Column:
    return F.array(*[(star == s).cast("int") for s in MULTI_STARS])


def one_hot_binary(star: Column) -> Column:
    negative = star <= 2
    return F.array(negative.cast("int"), (~negative).cast("int"))


def one_hot(star: Column, num_classes: int) -> Column:
    return one_hot_binary(star) if check_classes(num_classes) == 2 else one_hot_multi(star)


def class_of(one_hot_label: Column) -> Column:
    """0-based class of a one-hot label or a score vector, first on ties."""
    position = F.array_position(one_hot_label, F.array_max(one_hot_label))
    return (position - 1).cast("int")


def stars_of(class_index: Column) -> Column:
    return class_index + 1


def class_name(class_index: Column) -> Column:
    """Name of a binary class."""
    return F.when(class_index == 0, "negative").when(class_index == 1, "positive")
