"""Compression classifier: two zstandard dictionaries, one of good and one of bad text.

A text that the dictionary of good text shrinks further than that of bad text
reads like good text. The difference of the two sizes over their mean is turned
into a probability by a calibration curve fitted on labelled texts that the
dictionaries have not seen.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revtext.llm.batches import map_batches, utf8

#: Bounds of the labelled sample: texts of each class, and bytes of each class.
SAMPLE_TEXTS = 6_000
SAMPLE_BYTES = 12 << 20
#: Longer texts are not learned from.
LONGEST = 1 << 20
DICTIONARY_BYTES = 110 << 10
LEVEL = 3
#: Texts are compressed in blocks, so that a dictionary counts all through long ones.
BLOCK_BYTES = 4 << 10


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    learn: Column,
    max_texts: int = SAMPLE_TEXTS,
    max_bytes: int = SAMPLE_BYTES,
) -> list[tuple[bytes, int]]:
    """At most ``max_texts`` texts and ``max_bytes`` bytes of each class where ``learn`` holds.

    Rows are taken by the hash of their id, so the sample is the same in every
    run. The size of a class sets the hash below which rows come into question,
    so what tasks send to the driver is bounded like the sample. Ids and sizes
    are chosen first; only chosen texts reach the driver.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("y"))
    known = known.where(learn).withColumn("o", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)))
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    reach = {y: _hash_reach(counts.get(y, 0), max_texts) for y in (0, 1)}
    few = known.where(F.col("o") < F.when(F.col("y") == 1, reach[1]).otherwise(reach[0]))
    sized = docs.select("doc_id", F.octet_length("text").alias("bytes")).where(f"bytes <= {LONGEST}")
    rows = sized.join(few, "doc_id").groupBy("doc_id", "y", "o").agg(F.max("bytes").alias("bytes"))
    chosen: dict = {}
    left = {y: [max_texts, max_bytes] for y in (0, 1)}
    for r in sorted(rows.collect(), key=lambda r: (r.o, r.doc_id)):
        if left[r.y][0] > 0 and left[r.y][1] >= r.bytes:
            left[r.y] = [left[r.y][0] - 1, left[r.y][1] - r.bytes]
            chosen[r.doc_id] = r.y
    id_type = docs.schema["doc_id"].dataType.simpleString()
    keys = spark.createDataFrame([*chosen.items()], f"doc_id {id_type}, y int")
    texts = docs.select("doc_id", "text").where(F.octet_length("text") <= LONGEST)
    picked = texts.join(F.broadcast(keys), "doc_id")  # max_texts rows a class
    found = picked.groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()
    return [(r.text.encode(), r.y) for r in sorted(found, key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id))]


def _hash_reach(count: int, wanted: int) -> int:
    """Below this of 2 ** 30, hashes of ``count`` rows are near one and a half times ``wanted``, or all."""
    return 1 << 30 if count <= 1.5 * wanted else int((1 << 30) * 1.5 * wanted / count)


@dataclass
class Classifier:
    good: bytes
    bad: bytes
    slope: float
    offset: float

    def compressors(self) -> tuple:
        out = []
        for raw in (self.good, self.bad):
            words = zstandard.ZstdCompressionDict(raw)
            words.precompute_compress(level=LEVEL)
            params = {"level": LEVEL, "write_checksum": False, "write_content_size": False}
            out.append(zstandard.ZstdCompressor(dict_data=words, write_dict_id=False, **params))
        return tuple(out)

    def probability(self, difference: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * difference + self.offset)))


def normalised_difference(text: bytes, good, bad) -> float:
    """Size with the dictionary of bad text less that with good text, over their mean; empty 0."""
    sizes = [0, 0]
    for at in range(0, len(text), BLOCK_BYTES):
        block = text[at : at + BLOCK_BYTES]
        sizes[0] += len(good.compress(block))
        sizes[1] += len(bad.compress(block))
    return 2 * (sizes[1] - sizes[0]) / sum(sizes) if text else 0.0


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton's method, slightly held back."""
    scale = max(float(np.abs(x).mean()), 1e-9)
    design = np.stack([x / scale, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, design.T @ (y - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def train(sample: list[tuple[bytes, int]]) -> Classifier:
    """Dictionaries from two thirds of the sample, the curve from the other third.

    A class without enough text for a dictionary gets its text itself as one.
    """
    parts: dict[int, list[bytes]] = {0: [], 1: []}
    rest = []
    for i, (text, y) in enumerate(sample):
        if i % 3:
            parts[y].append(text)
        else:
            rest.append((text, y))
    size = min(DICTIONARY_BYTES, *(max(256, sum(map(len, p)) // 4) for p in parts.values()))
    found = Classifier(_dictionary(parts[1], size), _dictionary(parts[0], size), 0.0, 0.0)
    coders = found.compressors()
    x = np.array([normalised_difference(t, *coders) for t, _ in rest or sample])
    y = np.array([y for _, y in rest or sample], float)
    if len(x):
        found.slope, found.offset = _logistic(x, y)
    return found


def _dictionary(texts: list[bytes], size: int) -> bytes:
    blocks = [t[at : at + 1024] for t in texts for at in range(0, len(t), 1024)]
    try:
        return zstandard.train_dictionary(size, blocks).as_bytes()
    except zstandard.ZstdError:  # too little text
        return b"".join(texts)[-size:] or b" " * 8


def classify(
    docs: DataFrame,
    model: Classifier,
    threshold: float = 0.5,
    score_col: str = "score",
    predicted_col: str = "predicted",
) -> DataFrame:
    """All columns of ``docs``, then ``score_col`` and ``predicted_col``, which ``docs`` must not have.

    Every row is scored; null and empty texts get the score of difference 0.
    """
    if clash := {score_col, predicted_col} & set(docs.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    at, names = docs.columns.index("text"), docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = model.compressors()
        for batch in batches:
            x = [normalised_difference(t, good, bad) for t in utf8(batch.column(at))]
            scores = pa.array(model.probability(np.array(x, float)))
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*names, score_col])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    scored = map_batches(docs, work, f"{kinds}, `{score_col}` double")
    predicted = (F.col(f"`{score_col}`") >= threshold).cast("int")
    return scored.withColumn(predicted_col, predicted)


def held_out(part: int, of: int = 3) -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(F.col("doc_id").cast("string")) % of == part


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Classifier:
    learn = F.coalesce(~held_out(1), F.lit(False))
    return train(labelled_sample(docs, labels, label, learn))
