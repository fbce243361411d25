"""Merkle manifest, whitening and sharding against plain versions, and their edge rows."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from revtext.llm import merkle, sharding, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Merkle


def plain_leaf(row, lower=False):
    text = row[1]
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    fields = (row[0], row[3], row[2], row[4], text)
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def plain_tree(digests):
    """Root and, for each leaf, (place, run) level by level."""
    proofs, nodes, under = [[] for _ in digests], list(digests), [[i] for i in range(len(digests))]
    while len(nodes) > 1:
        ups, under_ups = [], []
        for at in range(0, len(nodes), 16):
            run = nodes[at : at + 16]
            for k, leaves in enumerate(under[at : at + 16]):
                for leaf in leaves:
                    proofs[leaf].append((k, run))
            ups.append(sha("".join(run)))
            under_ups.append([x for leaves in under[at : at + 16] for x in leaves])
        nodes, under = ups, under_ups
    return nodes[0], proofs


def plain_manifest(rows):
    per_source = defaultdict(list)
    for row in rows:
        per_source[row[3]].append((row[0], plain_leaf(row), row))
    sources = sorted(per_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        per_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[s] = plain_tree([r[1] for r in per_source[s]])
    root, tops = plain_tree([trees[s][0] for s in sources])
    found = []
    for k, s in enumerate(sources):
        for (doc_id, leaf, row), proof in zip(per_source[s], trees[s][1], strict=True):
            steps = proof + tops[k]
            siblings = "".join("".join(run[:at] + run[at + 1 :]) for at, run in steps)
            tampered = doc_id is not None and crc32(str(doc_id).encode()) % 5 == 0
            fold = plain_leaf(row, lower=tampered)
            for at, run in steps:
                fold = sha("".join([*run[:at], fold, *run[at + 1 :]]))
            found.append((doc_id, leaf, trees[s][0], root, sha(siblings), fold, fold == root))
    return found


def same_rows(a, b):
    return Counter(map(tuple, a)) == Counter(map(tuple, b))


def merkle_rows(spark, rows):
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    return merkle.digest(merkle.manifest(docs)).collect()


@pytest.mark.parametrize("sizes", [(1,), (2,), (16,), (17, 1), (256, 257, 3), (40,) * 18, (4096, 4097, 9000)])
def test_manifest_equals_the_plain_trees(spark, sizes):
    rows, draw = [], random.Random(3)
    for s, size in enumerate(sizes):
        rows += [(0, f"Text {i} ÄB", "en", f"s{s}", i) for i in range(size)]
    draw.shuffle(rows)
    rows = [(i * 7 - 50, *r[1:]) for i, r in enumerate(rows)]
    assert same_rows(merkle_rows(spark, rows), plain_manifest(rows))


def test_manifest_takes_nulls_ties_and_empty_tables(spark):
    rows = [
        (None, "A", "en", None, 1), (None, None, None, None, None), (1, "", "", "", 0), (1, None, "", "", 0), (1, "", "", "", 0),
        (2, "Q" * 1_000_000, "en", "é", 1_000_000), (-3, "x", None, "z", None), (3, "5:-", "-", "~", 3),
    ]
    assert same_rows(merkle_rows(spark, rows), plain_manifest(rows))
    assert merkle_rows(spark, []) == []


def test_manifest_finds_tampering_and_ignores_other_columns(spark):
    rows = [(i, "Aa" if i % 2 else "aa", "en", "s", 2) for i in range(200)]
    docs = spark.createDataFrame(rows, DOCS)
    clash = docs.withColumn("tree", F.lit(1)).withColumn("digest", F.lit(2)).withColumn("pos", F.lit(3))
    found = {r.doc_id: r.verified for r in merkle.digest(merkle.manifest(clash)).collect()}
    assert found == {r[0]: not (crc32(str(r[0]).encode()) % 5 == 0 and r[0] % 2) for r in rows}


def test_a_proof_is_read_by_itself(spark):
    rows = [(i, f"t{i}", "en", f"s{i % 3}", 2) for i in range(100)]
    for r in merkle.manifest(spark.createDataFrame(rows, DOCS)).collect():
        node = r.leaf
        for step in r.proof:
            node = sha(step.siblings[: 64 * step.at] + node + step.siblings[64 * step.at :])
        assert node == r.root


# Whitening


def whitened(spark, rows, **more):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return whitening.whitened_components(table.repartition(3), **more)


def test_covariances_are_exact(spark):
    draw = np.random.default_rng(1)
    vectors = draw.normal(size=(700, 6)) @ draw.normal(size=(6, 6))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(vectors.astype(np.float32))]
    fitted = whitening.fit_list(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    model = whitening.fit(fitted)
    x = [[math.floor(1024 * c) + 100_000 for c in r[1]] for r in rows]
    n, sums = len(x), [sum(v) for v in zip(*x, strict=True)]
    assert (model.n, list(model.sums)) == (n, sums)
    for i in range(6):
        for j in range(6):
            exact = sum((Fraction(v[i]) - Fraction(sums[i], n)) * (v[j] - Fraction(sums[j], n)) for v in x) / n
            assert model.covariance[i, j] == float(exact)


def test_whitened_rows(spark):
    draw = np.random.default_rng(2)
    vectors = (draw.normal(size=(900, 12)) * np.arange(1, 13)).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(vectors)]
    found = whitened(spark, rows).collect()
    x = np.floor(1024 * vectors.astype(float)).astype(np.int64) + 100_000
    centred = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / len(x))
    assert len(found) == 900 * 8 and {r.n for r in found} == {900}
    assert {r.vec_id: int(r.deviation) for r in found} == dict(enumerate(((900 * x - x.sum(axis=0)) ** 2).sum(axis=1).tolist()))
    for k in range(1, 9):
        got = np.array([r.whitened for r in sorted(found, key=lambda r: r.vec_id) if r.component == k])
        want = centred @ axes[:, -k] / math.sqrt(values[-k])
        assert np.allclose(got, want) or np.allclose(got, -want)
        assert {round(r.explained, 9) for r in found if r.component == k} == {round(values[-k] / values.sum(), 9)}
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-8


def test_whitening_drops_broken_vectors_only(spark):
    good = [(i, [float(i % 3), float(i % 5), 1.0]) for i in range(40)] + [(None, [3.0, 1.0, 1.0]), (5, [2.0, 0.0, 1.0])]
    bad = [(90, None), (91, []), (92, [1.0, None, 2.0]), (93, [1.0, float("nan"), 2.0]), (94, [float("inf"), 0.0, 1.0]), (95, [1.0])]
    found = whitened(spark, good + bad).collect()
    # The third dimension never varies, so there are two components.
    assert Counter(r.component for r in found) == {1: 42, 2: 42}
    assert Counter(r.vec_id for r in found if r.component == 1) == Counter(r[0] for r in good)
    assert {r.n for r in found} == {42} and found[0].identity_error < 1e-8


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])]])
def test_nothing_to_whiten(spark, rows):
    found = whitened(spark, rows)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert found.count() == 0


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(2 ** (i % 30)), float(-i * 2.0**28)]) for i in range(64)]
    model = whitening.fit(whitening.fit_list(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    x = [[int(c) * 1024 + 100_000 for c in r[1]] for r in rows]
    for i in range(2):
        for j in range(2):
            mean = [Fraction(sum(v[k] for v in x), 64) for k in (0, 1)]
            assert model.covariance[i, j] == float(sum((v[i] - mean[i]) * (v[j] - mean[j]) for v in x) / 64)


# Sharding


def plain_minimax(sizes, shards):
    """Least capacity of a contiguous partition, by dynamic programming."""
    ends = [0]
    for s in sizes:
        ends.append(ends[-1] + s)
    best = ends[:]
    for _ in range(shards - 1):
        best = [min(max(best[k], ends[i] - ends[k]) for k in range(i + 1)) for i in range(len(ends))]
    return best[-1]


def sharded(spark, texts, shards=8):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    return sharding.shard(spark.createDataFrame(rows, DOCS).repartition(4), shards).collect()


@pytest.mark.parametrize("seed", range(4))
def test_capacity_is_the_least(spark, seed):
    draw = random.Random(seed)
    texts = ["".join(draw.choices("abé ", k=draw.randint(0, 300))) for _ in range(60)]
    texts += draw.choices(texts, k=80)
    sized = sharding.sized_rows(spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], DOCS))
    cuts = sharding.find_cuts(sized, 5)
    groups = Counter()
    for t in texts:
        groups[hashlib.sha256(t.encode()).hexdigest()] += len(t.encode()) + 1
    rest = [size for digest, size in sorted(groups.items()) if digest not in cuts.alone]
    assert cuts.capacity == plain_minimax(rest, 5 - len(cuts.alone))
    placed = Counter()
    for digest, size in groups.items():
        placed[len(cuts.alone) + sum(digest > c for c in cuts.last) if digest not in cuts.alone else -1] += size
    assert max(size for k, size in placed.items() if k >= 0) <= cuts.capacity


def test_shards_hold_equal_texts_together_and_slots_are_gapless(spark):
    draw = random.Random(9)
    texts = [f"text {draw.randint(0, 400)} " * draw.randint(1, 9) for _ in range(1500)] + ["", None, "", None]
    texts += ["same " * 40] * 700
    found = sharded(spark, texts)
    assert len(found) == len(texts)
    of_text, slots, sizes = defaultdict(set), defaultdict(list), Counter()
    for r in found:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, crc32(data), "bytes", None)
        of_text[texts[r.doc_id]].add(r.shard)
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(len(s) == 1 for s in of_text.values()) and set(slots) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # The copies take a shard of their own; the others are near equal.
    assert max(sizes.values()) == 201 * 700
    others = sorted(sizes.values())[:-1]
    assert others[-1] < 1.1 * sum(others) / 7


def test_few_groups_ties_nulls_and_empty_tables(spark):
    assert sharded(spark, []) == []
    for texts in ([None], ["a", "a", "a"], ["a", "b"], ["x" * 10, "y" * 10, "z" * 10] * 3, ["q" * 1_000_000, "b", "c"]):
        found = sharded(spark, texts)
        assert len({r.shard for r in found}) == len(set(texts)) and all(0 <= r.shard < 8 for r in found)
    rows = [(None, "a", "", "", 0)] * 5 + [(1, "a", "", "", 0)] * 5 + [(1, "b", "", "", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("shard", F.lit("x")).withColumn("digest", F.lit(1))
    found = sharding.shard(docs).collect()
    per = Counter(r.shard for r in found)
    assert sorted(per.values()) == [1, 10]
    assert Counter((r.shard, r.slot) for r in found) == Counter((s, i) for s, n in per.items() for i in range(n))


def test_sharding_runs_without_python(spark):
    plan = sharding.shard(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    text = plan._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text
