"""Quality rules: repetition counts and perplexity bands of an n-gram model.

A text is a sequence of symbols: its code points in lower case, digits alike. Spark counts
every run of ``ORDER`` symbols of every document, per language, works out modified
Kneser-Ney probabilities by grouping and joining distinct runs, and every
task looks its runs up in arrays sorted by the hash of language and run. Perplexity is per word with a
letter: signs strung between or behind words cost, but do not count.

Texts fall into two halves, and a text is scored by the counts of the half it
is not in: neither its own runs nor those of its copies make it look usual. The half follows
from the least hash of its windows, so near copies are mostly in one half too.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revtext.llm.batches import map_batches, texts
from revtext.storage import stage

ORDER = 5
BITS = 12

#: Code points below are symbols of their own; others share 256 by residue.
OWN_SYMBOLS = 0xF00

#: Bands reach this many interquartile ranges beyond the quartiles: of normal data, one in 10 million.
BAND_REACH = 4.0
#: The range counts as at least this share of the median, so that alike texts leave a band.
LEAST_SPREAD = 0.02

MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
WINDOW_WORDS = 5

#: Runs of a model that tasks hold at once, 16 bytes each. A larger model is applied part by part.
PART_RUNS = 8_000_000

#: Copies of the row of a language in joins, and so of tasks that share one language.
SALTS = 64

#: Runs that a task gathers before it adds them up.
GATHERED_RUNS = 1 << 20

# ASCII white space as the word rule has it, and the symbol characters counted.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

START = 0

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Symbols of the windows of which the least hash decides a text's half, in runs.
WINDOW_RUNS = 4

HALVES = (0, 1)

#: This share of the usual texts is never below a band, so that no larger group of alike texts is.
LOW_SHARE = 0.005

#: Scripts without spaces, where each character counts as a word.
SINGLE = ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol of each code point, whether it is a letter, and whether it is a word by itself."""
    points = np.arange(0x110000)
    symbol = np.where(points < OWN_SYMBOLS, points, OWN_SYMBOLS + points % 256).astype(np.int64)
    letter = np.zeros(0x110000, bool)
    for c in range(0x40000):
        letter[c] = chr(c).isalpha()
    for c in range(OWN_SYMBOLS):
        low = chr(c).lower()
        if len(low) == 1 and ord(low) < OWN_SYMBOLS:
            symbol[c] = ord(low)
        if chr(c).isdigit():
            symbol[c] = ord("0")
    single = np.zeros(0x110000, bool)
    for first, last in SINGLE:
        single[first : last + 1] = True
    return symbol, letter, single & letter


SYMBOL_OF, IS_LETTER, IS_SINGLE = _tables()
IS_SPACE = np.zeros(0x110000, bool)
IS_SPACE[[ord(c) for c in SPACE]] = True


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def runs(points: np.ndarray) -> np.ndarray:
    """The run of ``ORDER`` symbols that ends at each character, packed into an integer."""
    symbols = np.full(len(points) + ORDER - 1, START, np.int64)
    symbols[ORDER - 1 :] = SYMBOL_OF[points]
    out = symbols[: len(points)].copy()
    for k in range(1, ORDER):
        out = out << BITS | symbols[k : k + len(points)]
    return out


def half_of(found: np.ndarray) -> int:
    """The half of a text, from its runs: a bit of the least hash of its windows."""
    if not len(found):
        return 0
    wide = _mixed(np.uint64(0), found)
    size = max(0, min(WINDOW_RUNS - 1, (len(found) - 1) // ORDER))
    for k in range(1, size + 1):
        wide = _mixed(wide[ORDER:], found[k * ORDER :])
    return int(_mixed(np.uint64(1), wide.min(keepdims=True))[0] >> np.uint64(17)) & 1


def letter_words(points: np.ndarray) -> int:
    """Words with a letter; characters of scripts without spaces count one each."""
    single = IS_SINGLE[points]
    word = np.cumsum(IS_SPACE[points])[IS_LETTER[points] & ~single]
    return int(single.sum()) + (1 + int((np.diff(word) != 0).sum()) if len(word) else 0)


def word_counts(text: str, points: np.ndarray) -> tuple[int, int, int, int, int]:
    """Words, their characters, symbols, repeated lines, and words in repeated windows of five."""
    words = text.encode("utf-8", "surrogatepass").split()
    spaces = int(((points == 32) | ((points >= 9) & (points <= 13))).sum())
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(SPACE)]
    windows = [*zip(*(words[k:] for k in range(WINDOW_WORDS)), strict=False)]
    repeated = 0
    if len(set(windows)) < len(windows):
        seen = Counter(windows)
        covered = np.zeros(len(words) + 1, np.int64)
        for i, w in enumerate(windows):
            if seen[w] > 1:
                covered[i] += 1
                covered[i + WINDOW_WORDS] -= 1
        repeated = int((np.cumsum(covered) > 0).sum())
    return len(words), len(points) - spaces, symbols, len(lines) - len(set(lines)), repeated


# The model


class _Counts:
    """Counts of the runs of one language in one task: runs in order, and a column of counts per half."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.loose = 0

    def add(self, found: np.ndarray, half: int) -> None:
        run, n = np.unique(found, return_counts=True)
        counts = np.zeros((len(run), 2), np.int64)
        counts[:, half] = n
        self.parts.append((run, counts))
        self.loose += len(run)
        if self.loose > max(GATHERED_RUNS, len(self.parts[0][0])):
            self.parts, self.loose = [self.total()], 0

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        run, back = np.unique(np.concatenate([p[0] for p in self.parts]), return_inverse=True)
        counts = np.concatenate([p[1] for p in self.parts])
        return run, np.stack([np.bincount(back, counts[:, f], len(run)) for f in HALVES], 1).astype(np.int64)


def count_runs(docs: DataFrame) -> DataFrame:
    """``lang, run, n0, n1``: occurrences of every run in the documents of either half; tasks add up their own first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Counts] = {}
        for batch in batches:
            found: dict[tuple[str, int], list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                own = runs(code_points(text))
                found.setdefault((lang, half_of(own)), []).append(own)
            for (lang, half), parts in found.items():
                held.setdefault(lang, _Counts()).add(np.concatenate(parts), half)
        for lang, counts in held.items():
            run, n = counts.total()
            columns = [pa.array([lang] * len(run), pa.string()), pa.array(run), pa.array(n[:, 0]), pa.array(n[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "run", "n0", "n1"])

    counts = map_batches(docs.select(language(), "text"), work, "lang string, run long, n0 long, n1 long")
    return counts.groupBy("lang", "run").agg(*(F.sum(f"n{f}").alias(f"n{f}") for f in HALVES))


def language() -> Column:
    """The actual value; null is as empty."""
    return F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang")


def _of_language(rows: DataFrame, table: DataFrame, spread_by: str) -> DataFrame:
    """``rows`` with the columns of a table that has a row per language; none of them is one task's work."""
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int")
    return rows.withColumn("_salt", salt).join(salted, ["lang", "_salt"], "left").drop("_salt")


def _discounted(f: int) -> Column:
    """The modified Kneser-Ney discount of a count of half ``f``, from its counts of counts."""
    n = F.col(f"n{f}")
    c1, c2, c3, c4 = (F.col(f"c{f}{k}").cast("double") for k in (1, 2, 3, 4))
    y = c1 / (c1 + 2 * c2)

    def clamped(d: Column, most: float) -> Column:
        known = F.least(F.greatest(d, F.lit(0.05)), F.lit(most))
        return F.when((c1 > 0) & (c2 > 0), known).otherwise(0.5)

    one = clamped(1 - 2 * y * c2 / F.greatest(c1, F.lit(1.0)), 0.95)
    two = clamped(2 - 3 * y * c3 / F.greatest(c2, F.lit(1.0)), 1.95)
    more = clamped(F.when(c3 > 0, 3 - 4 * y * c4 / F.greatest(c3, F.lit(1.0))).otherwise(1.5), 2.95)
    return F.when(n == 0, 0.0).when(n == 1, one).when(n == 2, two).otherwise(more)


def _suffix(run: Column, order: int) -> Column:
    return run.bitwiseAND(F.lit((1 << BITS * order) - 1).cast("long"))


def probabilities(counts: DataFrame) -> DataFrame:
    """``lang, run, logp0, logp1``: interpolated modified Kneser-Ney by the counts of either half, stored.

    Of every run of ``count_runs``; one that a half has not seen has what its shorter ending has. A lower
    order counts the distinct symbols before a run. Order 1 is interpolated with an even
    share for every symbol of the language and one unknown.
    """
    level = stage(counts, "runs")
    levels = [level]
    for order in range(ORDER - 1, 0, -1):
        kinds = (F.sum((F.col(f"n{f}") > 0).cast("long")).alias(f"n{f}") for f in HALVES)
        level = level.groupBy("lang", _suffix(F.col("run"), order).alias("run")).agg(*kinds)
        level = stage(level, f"runs-{order}")
        levels.append(level)
    below = None
    for order, grams in enumerate(reversed(levels), 1):
        of_counts = [F.sum((F.col(f"n{f}") == k).cast("long")).alias(f"c{f}{k}") for f in HALVES for k in (1, 2, 3, 4)]
        of_lang = grams.groupBy("lang").agg(*of_counts, F.count(F.lit(1)).alias("kinds"))
        cut = _of_language(grams, of_lang, "run").select(
            "lang", "run", "n0", "n1", "kinds", F.shiftright("run", BITS).alias("context"),
            *(_discounted(f).alias(f"cut{f}") for f in HALVES),
        )
        sums = [F.sum(f"{c}{f}").alias(f"all_{c}{f}") for c in ("n", "cut") for f in HALVES]
        context = cut.groupBy("lang", "context").agg(*sums)
        if below is None:
            even = 1 / (F.col("kinds") + 1)
            cut = _of_language(cut, context.drop("context"), "run").withColumns({f"below{f}": even for f in HALVES})
        else:
            cut = cut.join(context, ["lang", "context"])
            cut = cut.withColumn("suffix", _suffix(F.col("run"), order - 1)).join(below, ["lang", "suffix"])

        def p(f: int) -> Column:
            own = F.col(f"n{f}") - F.col(f"cut{f}") + F.col(f"all_cut{f}") * F.col(f"below{f}")
            return F.when(F.col(f"all_n{f}") > 0, own / F.col(f"all_n{f}")).otherwise(F.col(f"below{f}"))

        if order < ORDER:
            shares = cut.select("lang", F.col("run").alias("suffix"), *(p(f).alias(f"below{f}") for f in HALVES))
            below = stage(shares, f"shares-{order}")
    return stage(cut.select("lang", "run", *(F.log(p(f)).cast("float").alias(f"logp{f}") for f in HALVES)), "model")


def _mixed(seed: np.ndarray, run: np.ndarray) -> np.ndarray:
    """64-bit hash of a run; one to one for each seed, as every step can be undone."""
    x = run.astype(np.uint64) ^ seed
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _seed(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass")))


@dataclass
class Arrays:
    """Log probabilities, a column per half, by the sorted hash of language and run.

    ``starts`` has where the hashes of each value of the leading bits begin, about one each.
    """

    keys: np.ndarray
    logp: np.ndarray
    starts: np.ndarray
    shift: np.uint64

    @classmethod
    def sorted_by_hash(cls, keys: np.ndarray, logp: np.ndarray) -> Arrays:
        order = np.argsort(keys)
        bits = max(1, len(keys).bit_length())
        shift = np.uint64(64 - bits)
        starts = np.searchsorted(keys[order] >> shift, np.arange(1 << bits, dtype=np.uint64))
        return cls(keys[order], logp[:, order], starts.astype(np.int32), shift)

    @classmethod
    def collected(cls, model: DataFrame) -> Arrays:
        """Of at most a part of a model."""
        table = model.toArrow()
        of_lang = table["lang"].combine_chunks().dictionary_encode()
        seeds = np.array([_seed(x) for x in of_lang.dictionary.to_pylist()], np.uint64)
        keys = _mixed(seeds[of_lang.indices.to_numpy()], table["run"].to_numpy())
        return cls.sorted_by_hash(keys, np.stack([table[f"logp{f}"].to_numpy() for f in HALVES]))

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash, and whether it is there."""
        last = len(self.keys) - 1
        at = np.minimum(self.starts[wanted >> self.shift], last)
        key = self.keys[at]
        open_ = np.flatnonzero(key < wanted)
        while len(open_):
            at[open_] += 1
            open_ = open_[at[open_] <= last]
            key[open_] = self.keys[at[open_]]
            open_ = open_[key[open_] < wanted[open_]]
        return np.minimum(at, last), key == wanted

    def nats(self, lang: str, found: np.ndarray) -> float:
        """Minus the summed log probabilities, by the other half, of the runs held here."""
        if not len(self.keys) or not len(found):
            return 0.0
        at, there = self.find(_mixed(_seed(lang), found))
        logp = self.logp[1 - half_of(found)]
        return -float(logp[at][there].sum(dtype=np.float64))


# Rules


def _scored(docs: DataFrame, arrays: Arrays) -> DataFrame:
    """``doc_id, lang, fp``, counts, ``letter_words`` and ``nats`` of the runs in ``arrays``, of every row."""
    fields = {f.name: f.dataType.simpleString() for f in docs.schema}
    held = docs.sparkSession.sparkContext.broadcast(arrays)  # PART_RUNS entries or few more

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for lang, text in zip(batch.column(2).to_pylist(), texts(batch.column(3)), strict=True):
                points = code_points(text)
                nats = held.value.nats(lang, runs(points))
                made.append((*word_counts(text, points), letter_words(points), nats))
            *counts, nats = zip(*made, strict=True)
            longs = [pa.array(c, pa.int64()) for c in counts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), *longs, pa.array(nats, pa.float64())],
                ["doc_id", "fp", "lang", *COUNTS, "letter_words", "nats"],
            )

    longs = ", ".join(f"{c} long" for c in (*COUNTS, "letter_words"))
    rows = docs.select("doc_id", "fp", "lang", "text")
    return map_batches(rows, work, f"doc_id {fields['doc_id']}, fp {fields['fp']}, lang string, {longs}, nats double")


def score(docs: DataFrame, part_runs: int = PART_RUNS) -> DataFrame:
    """``doc_id, lang, fp``, counts and ``log_perplexity`` (per word with a letter, null without one) of every row, stored.

    ``fp`` is a hash of the text. A model of more than ``part_runs`` runs is applied in parts, each
    adding its share to the rows, whose texts are read again for each.
    """
    model = probabilities(count_runs(docs))
    parts = max(1, math.ceil(model.count() / part_runs))
    rows = docs.select("doc_id", F.xxhash64("text").alias("fp"), language(), "text")
    if parts == 1:
        done = _scored(rows, Arrays.collected(model))
    else:
        # The row's number takes the place of the hash, and brings id and hash back.
        numbered = stage(rows.withColumn("row", F.monotonically_increasing_id()), "numbered-texts")
        by_row = numbered.select("doc_id", F.col("row").alias("fp"), "lang", "text")
        part = F.pmod(F.xxhash64("lang", "run"), F.lit(parts))
        found = [stage(_scored(by_row, Arrays.collected(model.where(part == k))), "scored-part") for k in range(parts)]
        first = found[0].withColumnRenamed("fp", "row")
        every = found[0].select("fp", "nats")
        for other in found[1:]:
            every = every.unionByName(other.select("fp", "nats"))
        total = every.groupBy(F.col("fp").alias("row")).agg(F.sum("nats").alias("nats"))
        done = first.drop("nats").join(total, "row").join(numbered.select("row", "fp"), "row").drop("row")
    log_perplexity = F.when(F.col("letter_words") > 0, F.col("nats") / F.col("letter_words"))
    return stage(done.withColumn("log_perplexity", log_perplexity).drop("nats", "letter_words"), "quality")


def base_failed() -> Column:
    too_repetitive = 100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")
    return (F.col("n_words") < MIN_WORDS) | too_repetitive


def bands(scored: DataFrame, reach: float = BAND_REACH) -> DataFrame:
    """``lang, low, high``: log perplexities that are usual, from distinct texts that pass the base rules.

    ``reach`` ranges beyond the quartiles, below also a range beyond the least ``LOW_SHARE``.
    """
    fair = scored.where(~base_failed() & F.col("log_perplexity").isNotNull())
    distinct = fair.groupBy("lang", "fp").agg(F.first("log_perplexity").alias("x"))
    shares = [LOW_SHARE, 0.25, 0.5, 0.75]
    quartiles = distinct.groupBy("lang").agg(F.percentile_approx("x", shares, 10_000).alias("q"))
    least, low, middle, high = (F.get("q", F.lit(k)) for k in range(4))
    spread = F.greatest(high - low, middle * LEAST_SPREAD)
    below = F.least(low - reach * spread, least - spread)
    return quartiles.select("lang", below.alias("low"), (high + reach * spread).alias("high"))


def quality_rules(docs: DataFrame, reach: float = BAND_REACH) -> DataFrame:
    """Counts, ``base_failed``, ``perplexity`` and ``kept`` of every row of ``docs``.

    Kept are rows that pass the base rules and whose log perplexity lies in the
    band of their language, ends included. Null texts count as empty and fail
    the base rules; texts without a letter have no perplexity and are not kept. Every ``lang``
    value has a model and a band, null that of the empty one. Copies are judged alike, shape the
    band once and do not make each other usual. Texts of any length are read whole. An empty table gives an empty result; other columns, also those named like
    results, are not read.
    """
    scored = score(docs)
    inside = _of_language(scored, bands(scored, reach), "fp")
    usual = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(False))
    return inside.select(
        "doc_id",
        *COUNTS,
        base_failed().alias("base_failed"),
        (~base_failed() & usual).alias("kept"),
        F.exp("log_perplexity").alias("perplexity"),
    )
