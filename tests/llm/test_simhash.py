"""SimHash near-duplicates against all pairs, and the components behind them."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from revtext.llm import simhash
from revtext.llm.components import components


def plain_fingerprint(text, shingle=3):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    grams = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius):
    found = {i: i for i in prints}

    def root(x):
        while found[x] != x:
            x = found[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                low, high = sorted((root(a), root(b)))
                found[high] = low
    return {i: root(i) for i in ids}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


TEXTS = ["", None, " \t\n", "One", "one two", "A B c d", "a b C D", "É é ı İ", "x" * 50_000, "w " * 30_000]


def test_fingerprint_is_that_of_the_rule(spark):
    df = spark.createDataFrame([*enumerate(TEXTS)], "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in simhash.near_duplicates(df).collect()}
    assert got == {i: f"{plain_fingerprint(t):016x}" for i, t in enumerate(TEXTS)}
    assert got[0] == "0" * 16


def test_every_pair_in_the_radius_shares_a_table():
    masks = simhash.covering_masks(2)
    assert len(masks) == 7
    for a in range(64):
        for b in range(a):
            bits = simhash._signed(1 << a | 1 << b)
            assert any(not m & bits for m in masks)


def test_components_agree_with_all_pairs(spark):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    prints = {}
    for i in range(400):
        x = rng.choice(centres)
        for _ in range(rng.choice((0, 1, 1, 2, 3, 6))):
            x ^= 1 << rng.choice((0, 5, 9, 17, 33, 40, 52, 63))
        prints[i] = x
    df = spark.createDataFrame([(i, signed(x)) for i, x in prints.items()], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.near_classes(df, "doc_id").collect()}
    assert got == plain_components(prints, 2)


def test_crowded_bucket_links_without_pairs(spark):
    """Thousands of fingerprints in one bucket."""
    df = spark.range(4096).select(F.col("id").alias("doc_id"), F.col("id").alias("fp"))
    got = simhash.near_classes(df, "doc_id")
    assert got.select("component_id").distinct().collect() == [(0,)]
    assert simhash.covering_links(df.select("fp")).count() < 4096 * 60


def test_components_of_a_chain_a_star_and_a_pair(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(300, 340)]
    links = spark.createDataFrame([*chain, *star, (2, 1), (1, 2), (5, 5)], "u long, v long")
    got = dict(components(links).collect())
    expected = {i: 100 for i in range(100, 161)} | {i: 7 for i in (7, *range(300, 340))} | {1: 1, 2: 1}
    assert got == expected


def test_repeated_rows_and_null_ids(spark):
    rows = [(3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (None, "q r s t"), (9, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(df).collect())
    assert got == [("3", "3"), ("3", "3"), ("8", "8"), ("9", "8"), ("None", "3"), ("None", "None")]


def test_one_row_of_each_class_stays(spark):
    rows = [(3, "a b c d", 1), (3, "a b c d", 1), (None, "a b c d", 2), (1, "q r s t", 3), (2, "q r s t", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect())) == [(1, "q r s t", 3), (3, "a b c d", 1)]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, component_id int")
    assert simhash.near_duplicates(df).collect() == []
    assert simhash.keep_one(df).collect() == []


def test_odd_radius_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.covering_links(spark.createDataFrame([], "fp long"), 3)
