"""SpotSigs: spot signatures of a text and their likeness, in DataFrame operations.

A common word is an anchor; with the next content words, over at most
``LOOK`` - 1 further anchors, it makes a chain. A text's fingerprint is the set
of the hashes of its chains. Two sets are compared through Jaccard; where their
sizes alone rule the wanted likeness out they are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revtext.storage import stage

# Common words of English, German, French and Spanish.
ANCHORS = (
    *"a an and are as at be but by for from had has have he her his in is it its not of on or".split(),
    *"she that the their they this to was were which who will with you".split(),
    *"als am auch auf aus bei bis dem den der des die das ein eine einem einen einer er es für".split(),
    *"ich im ist mit nach nicht noch oder sich sie sind und von vor war werden wie wird zu zum zur".split(),
    *"au aux avec ce ces dans de du elle en est et eux il ils je la le les leur lui mais ne nous".split(),
    *"on ou par pas plus pour que qui sa se ses son sur un une vous".split(),
    *"al como con del el ella ellos esta este ha hay la las lo los más muy no nos o para pero por".split(),
    *"porque se sin sobre su sus también todo unos y ya yo".split(),
)
CHAIN = 2
LOOK = 4


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def signatures(text: Column, anchors=ANCHORS, chain: int = CHAIN, look: int = LOOK) -> Column:
    """Sorted distinct hashes of the chains of a text, as an array of longs.

    Words are runs of letters and digits in lower case. A text without a
    complete chain has one hash, that of its words, so that equal texts agree
    and others do not.
    """
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")

    def of_words(words: Column) -> Column:
        # Every anchor opens a piece; each word ends in a space.
        marked = F.array_join(
            F.transform(words, lambda w: F.concat(F.when(w.isin(*anchors), F.lit("|")).otherwise(F.lit("")), w, F.lit(" "))),
            "",
        )

        def piece(p: Column) -> Column:
            anchor = F.substring_index(p, " ", 1)
            return F.struct(anchor.alias("anchor"), F.substr(p, F.length(anchor) + 2).alias("rest"))

        def chains(pieces: Column) -> Column:
            def one(p: Column, i: Column) -> Column:
                follow = F.concat(
                    p["rest"],
                    *(F.coalesce(F.get(pieces, i + k)["rest"], F.lit("")) for k in range(1, look)),
                )

                def complete(follow: Column) -> Column:
                    words = F.substring_index(follow, " ", chain)
                    return F.when(words != follow, F.xxhash64(p["anchor"], words))

                return _let(follow, complete)

            return F.array_sort(F.array_distinct(F.array_compact(F.transform(pieces, one))))

        cut = F.split(marked, r"\|")
        opened = F.slice(cut, F.lit(2), F.size(cut))
        found = _let(F.transform(opened, piece), chains)
        return _let(found, lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(F.xxhash64(F.array_join(words, " ")))))

    return _let(words, of_words)


def likeness(a: Column, b: Column, at_least: float = 0.0) -> Column:
    """Jaccard likeness of two sets; 0 where their sizes keep it below ``at_least``."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    value = F.when(large == 0, F.lit(1.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))
    if at_least <= 0:
        return value
    return F.when(small < at_least * large, F.lit(0.0)).otherwise(value)


def shown(signature: Column) -> Column:
    """A fingerprint as text: hexadecimal hashes in order."""
    return F.array_join(F.transform(signature, lambda s: F.lpad(F.lower(F.hex(s)), 16, "0")), " ")


def next_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, h, n_chars, next_id, next_h``: for each document the one after it, the first for the last.

    ``docs`` has ``doc_id, h, text``. Documents are distinct pairs of id and
    text hash, in that order, null ids first. Ids are dealt by range; only the
    first id of every range is looked at in one task.
    """
    keys = docs.groupBy("doc_id", "h").agg(F.max(F.length("text")).alias("n_chars"))
    dealt = keys.repartitionByRange("doc_id", "h").withColumn("block", F.spark_partition_id())
    dealt = stage(dealt, "order")
    key = F.struct("doc_id", "h")
    heads = dealt.groupBy("block").agg(F.min(key).alias("head"))
    by_block = Window.orderBy("block")
    first = F.first("head").over(by_block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("block", F.coalesce(F.lead("head").over(by_block), first).alias("after"))
    inside = Window.partitionBy("block").orderBy("doc_id", "h")
    led = dealt.withColumn("n", F.lead(key).over(inside)).join(heads, "block")
    found = F.coalesce("n", "after")
    return led.select("doc_id", "h", "n_chars", found["doc_id"].alias("next_id"), found["h"].alias("next_h"))


def edited_and_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row, of its text with the last quarter from the next document, and likeness.

    Columns: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``. A null text counts as empty. Rows that repeat id
    and text are one document and come out as often as they occur. Texts go
    through one exchange, which both joins read.
    """
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", F.xxhash64(text).alias("h"), text.alias("text"))
    order = stage(next_documents(docs), "next")

    def key(prefix: str, doc_id: str, h: str) -> list[Column]:
        """A key without nulls, so that a null id meets a null id."""
        known = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
        return [known.alias(f"{prefix}_id"), F.col(doc_id).isNull().alias(f"{prefix}_null"), F.col(h).alias(f"{prefix}_h")]

    # Both joins take the same columns of this, so that Spark exchanges the texts once.
    keyed = docs.select("text", *key("d", "doc_id", "h"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int").alias("quarter")
    order = order.select("doc_id", quarter, *key("k", "doc_id", "h"), *key("n", "next_id", "next_h"))
    parts = ("id", "null", "h")
    reached = order.join(keyed, [F.col(f"n_{p}") == F.col(f"d_{p}") for p in parts])
    own = [f"k_{p}" for p in parts]
    pieces = reached.select(
        *own, "doc_id", "quarter", F.left("text", F.col("quarter")).alias("piece"), signatures(F.col("text")).alias("next_set")
    )
    # A next document that occurs repeatedly gives one piece.
    pieces = pieces.groupBy(*own).agg(*(F.first(c).alias(c) for c in ("doc_id", "quarter", "piece", "next_set")))
    joined = pieces.join(keyed, [F.col(f"k_{p}") == F.col(f"d_{p}") for p in parts])
    n = F.length("text")
    texts = joined.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        "text",
        F.concat(F.left("text", n - F.col("quarter")), F.col("piece")).alias("edited"),
        "next_set",
    )
    sets = texts.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        signatures(F.col("text")).alias("own_set"),
        signatures(F.col("edited")).alias("edited_set"),
        "next_set",
    )
    return sets.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        shown(F.col("own_set")).alias("fingerprint"),
        shown(F.col("edited_set")).alias("edited_fingerprint"),
        likeness(F.col("own_set"), F.col("edited_set")).alias("near_edited"),
        likeness(F.col("own_set"), F.col("next_set")).alias("near_next"),
    )
