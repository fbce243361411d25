"""Verb lemmas by a lexicon of any size, as joins of the distinct words of the rows.

Gives what ``functions.lemma`` gives, whose lexicon has to fit a constant of the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revtext.functions.bloom import BloomFilter
from revtext.functions.lemma import SUFFIX_RULES
from revtext.functions.lookup import Lookup, small_table
from revtext.storage import stage

_LAST_SUFFIX = r"(?:es|s|ed|ing)\z"
_STACKED = r"(?:s|ed|ing)(?:e?s|ed|ing)\z"

#: So many changed words are told from the others by a set, which is probed in less time than the constant table.
MAX_LISTED = 1_000


def regular_forms(lexicon: DataFrame) -> DataFrame:
    """``form, lemma``: every form one suffix rule leads back to a ``lemma`` of the table, with the best one.

    The shortest lemma is best, then the first rule, then the order of words.
    """
    lemma = F.col("lemma")
    ways = [F.struct(F.lit(0).alias("rule"), lemma.alias("form"))]
    for order, (suffix, replacement) in enumerate(SUFFIX_RULES, start=1):
        stem = F.substring(lemma, F.lit(1), F.length("lemma") - len(replacement))
        formed = F.struct(F.lit(order).alias("rule"), F.concat(stem, F.lit(suffix)).alias("form"))
        ways.append(F.when(lemma.endswith(replacement), formed))
    each = lexicon.where("lemma IS NOT NULL").select("lemma", F.explode(F.array_compact(F.array(*ways))).alias("way"))
    best = F.min(F.struct(F.length("lemma").alias("length"), F.col("way.rule").alias("rule"), "lemma"))
    return each.groupBy(F.col("way.form").alias("form")).agg(best["lemma"].alias("lemma"))


def irregular_forms(exceptions: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``form, lemma`` of ``form, ord, lemma`` rows: the shortest known lemma, the form itself if none is."""
    own = exceptions.select("form", F.lit(0).alias("ord"), F.col("form").alias("lemma")).distinct()
    each = own.unionByName(exceptions.select("form", F.col("ord").cast("int").alias("ord"), "lemma"))
    known = each.join(lexicon.select("lemma").distinct(), "lemma", "left_semi")
    best = F.min(F.struct(F.length("lemma").alias("length"), "ord", "lemma"))
    found = known.groupBy("form").agg(best["lemma"].alias("lemma"))
    return own.select("form").join(found, "form", "left").select("form", F.coalesce("lemma", "form").alias("lemma"))


def _stems(word: Column, longest: int) -> Column:
    """What is left of a word as suffixes go one by one, from the first stem that can be a form on."""
    near = F.regexp_extract(word, rf"\A([\s\S]{{0,{longest}}})(?:es|ed|ing|(?<!e)s)++\z", 1)
    short = F.when(F.length(word) > longest, near).otherwise(word)

    def step(stems: Column, _: Column) -> Column:
        last = F.element_at(stems, -1)
        going = last.rlike(r"(?:s|ed|ing)\z")
        return F.when(going, F.concat(stems, F.array(F.regexp_replace(last, _LAST_SUFFIX, "")))).otherwise(stems)

    letters = F.length(F.regexp_extract(short, r"((?:e?s|ed|ing)+)\z", 1))
    rounds = F.when(letters > 0, F.sequence(F.lit(1), letters)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rounds, F.array(short), step)


def _stacked(word: Column) -> Column:
    # The plain suffix tests spare most words the regex.
    ending = word.endswith("s") | word.endswith("ed") | word.endswith("ing")
    return ending & word.rlike(_STACKED)


def word_lemmas(words: DataFrame, lexicon: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """``word, lemma`` of the distinct ``word`` rows whose lemma is another word.

    Only words that may be a form, or end in several suffixes, leave their task: the filter sinks below
    the exchange that makes the words distinct.
    """
    regular = stage(regular_forms(lexicon), "regular-forms")
    first = regular
    if exceptions is not None:
        listed = irregular_forms(exceptions, lexicon)
        first = regular.join(listed.select("form"), "form", "left_anti").unionByName(listed)
        first = stage(first, "first-forms")
    longest = regular.agg(F.max(F.length("form"))).first()[0] or 0
    may_change = BloomFilter(first, "form").may_hold(F.col("word")) | _stacked(F.col("word"))
    words = words.where(F.col("word").isNotNull() & may_change)
    direct = stage(words.join(first.withColumnRenamed("form", "word"), "word", "left"), "direct-lemmas")
    stacked = direct.where(F.col("lemma").isNull() & _stacked(F.col("word"))).select("word")
    stems = stacked.select("word", F.posexplode(_stems(F.col("word"), longest)).alias("round", "form"))
    best = F.min(F.struct("round", "lemma"))
    later = stems.join(regular, "form").groupBy("word").agg(best["lemma"].alias("lemma"))
    return direct.where("lemma IS NOT NULL").unionByName(later).where("lemma <> word")


def lemmatize_table(
    df: DataFrame, lexicon: DataFrame, exceptions: DataFrame | None = None, tokens: str = "tokens"
) -> DataFrame:
    """``tokens`` of every row reduced to the lemmas of a ``lexicon`` table, order kept.

    ``lexicon`` has a ``lemma`` a row; ``exceptions`` has ``form, ord, lemma``, whose forms follow no rule. Each
    distinct word is reduced once. If few words change, they are a constant of the plan; otherwise rows are
    numbered and stored, and only the words that may change are joined and brought back.
    Null and empty token arrays and null tokens stay as they are.
    """
    if not lexicon.head(1):
        return df
    words = df.select(F.explode(tokens).alias("word")).distinct()
    changed = stage(word_lemmas(words, lexicon, exceptions), "changed-words")
    small = small_table(changed)
    if small is not None:
        entries = {row.word: row.lemma for row in small}
        lookup = Lookup(entries, "string")

        def reduced(t: Column) -> Column:
            lemma = F.coalesce(lookup.get(t), t)
            return F.when(t.isin(list(entries)), lemma).otherwise(t) if len(entries) <= MAX_LISTED else lemma

        return df.withColumn(tokens, F.transform(tokens, reduced))
    columns = df.columns
    rows = stage(df.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    met = rows.select("_row", F.posexplode(tokens).alias("pos", "word"))
    met = met.where(F.col("word").isNotNull() & BloomFilter(changed, "word").may_hold(F.col("word")))
    found = met.join(changed, "word").groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("pos", "lemma"))).alias("_found"))
    joined = rows.join(found, "_row", "left")
    reduced = F.transform(tokens, lambda t, i: F.coalesce(F.try_element_at("_found", i), t))
    return joined.withColumn(tokens, reduced).select(*columns)
