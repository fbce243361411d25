"""Verb lexicons in the public WordNet database format."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from revtext.functions.lemma import VerbLemmatizer


def read_verb_lexicon(spark: SparkSession, index_path: str, exceptions_path: str) -> VerbLemmatizer:
    """Lemmatizer over ``index.verb`` and ``verb.exc`` files.

    Both files are fixed resources of a few hundred kilobytes. Lines starting
    with a blank are the licence; the first field is the word. Compounds joined
    by "_" or "-" cannot match a word token and are left out.
    """
    fields = F.split("value", " +")
    index = spark.read.text(index_path).where(~F.col("value").startswith(" "))
    lemmas = index.select(fields[0].alias("lemma")).where(~F.rlike("lemma", F.lit("[-_]")))
    listed = spark.read.text(exceptions_path).where(F.size(fields) > 1)
    rows = listed.select(fields[0].alias("form"), F.slice(fields, F.lit(2), F.size(fields)).alias("lemmas")).collect()
    return VerbLemmatizer(
        [row.lemma for row in lemmas.collect()], {row.form: tuple(row.lemmas) for row in rows}
    )
