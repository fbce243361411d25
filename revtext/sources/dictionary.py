"""Dictionaries: one JSON object of word to index."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``(token, idx)`` rows of a JSON object of words and indices.

    Any layout of lines will do, so long as an entry is not broken over two;
    lines are read by many tasks. Spark's JSON reader refuses field names above
    50,000 characters, which a word may have, so a small Python step parses a line.
    """

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for line in batch["value"]:
                # Entries begin with a quotation mark and end with a digit.
                inner = line.strip().strip("{}, ")
                pairs = list(json.loads(f"{{{inner}}}").items())
                yield pd.DataFrame(pairs, columns=["token", "idx"])

    return spark.read.text(path).mapInPandas(entries, "token string, idx int")
