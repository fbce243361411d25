"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as the embedding of the word, if it is a known one, beside the
mean embedding of its character n-grams. Overlapping windows cover every word
of a text; the strongest window and the number of windows give the text's
score through a calibration curve. What a word adds to the gates does not
depend on its place, so a worker computes it once per word and keeps it.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revtext.llm.batches import map_batches, texts
from revtext.llm.compression import labelled_sample

WINDOW, STEP = 48, 32
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 12, 16, 10, 8
KNOWN_WORDS = 4_000
CHAR_BITS = 14
WORD_CHARS = 24
#: Where the next part of a long word begins; parts share the rest.
PART_STEP = 16
_RUN = re.compile(r"[^\W_]+")
#: Bounds of the labelled sample: texts and bytes of each class.
SAMPLE_TEXTS = 2_500
SAMPLE_BYTES = 4 << 20
EPOCHS, BATCH, RATE = 3, 128, 4e-3
#: Windows of label 0 trained on for each of label 1.
CLEAN_WINDOWS = 3
#: A small sample is gone through more often, for this many steps.
LEAST_STEPS = 250
#: Words whose gate inputs a worker keeps, and windows scored at once.
KEPT_WORDS = 150_000
SCORED = 512
FLOOR = -12.0


def words_of(text: str) -> list[str]:
    """The words between white space, in order; long ones in parts, so that every character is read.

    A long word falls apart at signs, and runs of letters and digits that are still long into
    overlapping parts.
    """
    words = text.split()
    if not words or max(map(len, words)) <= WORD_CHARS:
        return words
    out: list[str] = []
    for word in words:
        if len(word) <= WORD_CHARS:
            out.append(word)
            continue
        for run in _RUN.findall(word):
            if len(run) <= WORD_CHARS:
                out.append(run)
            else:
                out.extend(run[at : at + WORD_CHARS] for at in range(0, len(run) - WORD_CHARS + PART_STEP, PART_STEP))
    return out


def normalised(token: str) -> str:
    """Letters and digits at the core of a token, lower case."""
    token = token.lower()
    if token.isalnum():
        return token
    a, b = 0, len(token)
    while a < b and not token[a].isalnum():
        a += 1
    while b > a and not token[b - 1].isalnum():
        b -= 1
    return token[a:b]


def char_slots(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash slots of all words in a row, and their number per word.

    A word has its beginnings of 2 to 8 characters and its trigrams, both
    between end marks. Words come from ``words_of`` and are short; case may lengthen one by a little.
    """
    cut = [w[:WORD_CHARS] for w in words]
    sizes = np.array([len(w) for w in cut])
    marked = np.array([f"^{w}$" for w in cut], f"U{WORD_CHARS + 2}")
    points = marked.view(np.uint32).reshape(len(cut), -1).astype(np.uint64)
    grams, there = [], []
    running = np.zeros(len(cut), np.uint64)
    for k in range(9):
        running = running * np.uint64(1_000_003) + points[:, k]
        if k >= 2:
            grams.append(running ^ np.uint64(k << 40))
            there.append(sizes >= k)
    for k in range(WORD_CHARS):
        gram = points[:, k] << np.uint64(42) | points[:, k + 1] << np.uint64(21) | points[:, k + 2]
        grams.append(gram)
        there.append(sizes >= max(k + 1, 1))
    grams.append(points[:, 1] + np.uint64(1 << 50))  # so that no word is without a slot
    there.append(np.ones(len(cut), bool))
    mixed = np.stack(grams, axis=1) * np.uint64(0x9E3779B97F4A7C15)
    kept = np.stack(there, axis=1)
    slots = (mixed >> np.uint64(64 - CHAR_BITS)).astype(np.int64)
    return slots[kept], kept.sum(axis=1)


def slot_sums(table: np.ndarray, slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of the table's lines of each word; ``slots`` of all words in a row, words with most slots added first."""
    order = np.argsort(-counts, kind="stable")
    begin = (np.cumsum(counts) - counts)[order]
    falling = -counts[order]
    out = np.zeros((len(counts), table.shape[1]), table.dtype)
    for k in range(int(counts.max(initial=0))):
        there = np.searchsorted(falling, -k)
        out[:there] += table[slots[begin[:there] + k]]
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return out[back]


def window_rows(ids: np.ndarray) -> np.ndarray:
    """Overlapping windows over one text's word rows; -1 beyond its end."""
    count = max(1, -(-(len(ids) - (WINDOW - STEP)) // STEP))
    padded = np.full((count - 1) * STEP + WINDOW, -1, np.int32)
    padded[: len(ids)] = ids
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STEP]


_HALF = np.float32(0.5)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


@dataclass
class Network:
    known: dict[str, int]
    p: dict[str, np.ndarray]
    curve: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0, 0.0]))
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def inputs(self, words: np.ndarray, slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Word and character embedding of each word; ``slots`` of all words in a row."""
        chars = slot_sums(self.p["chars"], slots, counts) / counts[:, None].astype(np.float32)
        return np.concatenate([self.p["words"][words], chars], axis=1)

    def gates(self, words: list[str]) -> np.ndarray:
        """What each word adds to the gates of both directions, a row per word."""
        ids = np.array([self.known.get(w, 0) for w in words])
        return self.inputs(ids, *char_slots(words)) @ self.p["wx"] + self.p["bx"]


def start(vocabulary: list[str], seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)

    def draw(*shape: int, scale: float | None = None) -> np.ndarray:
        return (rng.standard_normal(shape) * (scale or shape[0] ** -0.5)).astype(np.float32)

    h = HIDDEN
    p = {
        "words": draw(len(vocabulary) + 1, WORD_DIM, scale=0.3),
        "chars": draw(1 << CHAR_BITS, CHAR_DIM, scale=0.5),
        "wx": draw(WORD_DIM + CHAR_DIM, 6 * h),
        "bx": np.zeros(6 * h, np.float32),
        "uf": draw(h, 3 * h),
        "ub": draw(h, 3 * h),
        "wa": draw(2 * h, ATTENTION),
        "va": draw(ATTENTION),
        "wo": draw(2 * h),
        "bo": np.zeros(1, np.float32),
    }
    return Network({w: i + 1 for i, w in enumerate(vocabulary)}, p)


def _halved(p) -> tuple[np.ndarray, np.ndarray]:
    """Both recurrent matrices, (direction, 3 * unit, unit), and what halves the arguments of the two gates.

    A sigmoid is computed from the tangent of half its argument; halves are exact.
    """
    half = np.ones(3 * HIDDEN, np.float32)
    half[: 2 * HIDDEN] = 0.5
    return np.stack([p["uf"].T, p["ub"].T]) * half[:, None], half


def _states(gates, rows, mask, p, trace=None):
    """States of both directions, (time, unit, window); ``gates`` has a line per word row.

    Step k is the kth word of the first direction and the kth from the end of the second. ``trace`` keeps
    what the way back needs.
    """
    h, length, width = HIDDEN, *rows.shape
    turned, half = _halved(p)
    table = np.ascontiguousarray(gates.T) * np.tile(half, 2)[:, None]
    whole = mask.all(axis=1)
    state = np.zeros((2, h, width), np.float32)
    states = np.empty((length, 2, h, width), np.float32)
    x = np.empty((2, 3 * h, width), np.float32)
    for k in range(length):
        ends = k, length - 1 - k
        for d, t in enumerate(ends):
            np.take(table[3 * h * d : 3 * h * (d + 1)], rows[t], axis=1, out=x[d], mode="clip")
        hu = turned @ state
        zr = x[:, : 2 * h] + hu[:, : 2 * h]
        np.tanh(zr, out=zr)
        zr *= _HALF
        zr += _HALF
        z, r = zr[:, :h], zr[:, h:]
        n = r * hu[:, 2 * h :]
        n += x[:, 2 * h :]
        np.tanh(n, out=n)
        if trace is not None:
            trace.append((state, z, r, n, hu[:, 2 * h :]))
        new = state - n
        new *= z
        new += n
        if not (whole[ends[0]] and whole[ends[1]]):
            new = np.where(mask[list(ends), None], new, state)
        state = new
        states[ends[0], 0], states[ends[1], 1] = state
    return states.reshape(length, 2 * h, width)


def _pool(p, states, mask):
    """Attention over time; ``states`` are (time, unit, window)."""
    a = np.tanh(p["wa"].T @ states)
    e = np.where(mask, p["va"] @ a, np.float32(-1e9))
    e = np.exp(e - e.max(axis=0))
    weights = e / e.sum(axis=0)
    pooled = (weights[:, None, :] * states).sum(axis=0)
    return a, weights, pooled, p["wo"] @ pooled + p["bo"][0]


def _rows_and_mask(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows = np.ascontiguousarray(windows.T)
    return np.maximum(rows, 0), rows >= 0


def window_scores(net: Network, gates: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Logit of each window of word rows; ``gates`` has a line per word row."""
    p = net.p
    out = np.empty(len(windows), np.float32)
    for at in range(0, len(windows), SCORED):
        used, local = np.unique(windows[at : at + SCORED], return_inverse=True)
        rows, mask = _rows_and_mask(local.reshape(-1, WINDOW) - (used[0] < 0))
        own = gates[used[used >= 0]] if used[-1] >= 0 else np.zeros((1, gates.shape[1]), np.float32)
        out[at : at + SCORED] = _pool(p, _states(own, rows, mask, p), mask)[3]
    return out


def gradients(net: Network, windows, targets, words, slots, counts):
    """Loss gradient over one batch; word rows index ``words`` and their slot lists."""
    p, h = net.p, HIDDEN
    rows, mask = _rows_and_mask(windows)
    x = net.inputs(words, slots, counts)
    gates = x @ p["wx"] + p["bx"]
    trace = []
    both = _states(gates, rows, mask, p, trace)
    a, weights, pooled, logit = _pool(p, both, mask)
    slip = ((_sigmoid(logit) - targets) / len(targets)).astype(np.float32)
    g = {"wo": pooled @ slip, "bo": slip.sum(keepdims=True)}
    d_pooled = p["wo"][:, None] * slip
    d_weights = (both * d_pooled).sum(axis=1)
    d_e = weights * (d_weights - (weights * d_weights).sum(axis=0))
    g["va"] = np.einsum("tb,tab->a", d_e, a)
    d_a = d_e[:, None, :] * p["va"][:, None] * (1 - a * a)
    g["wa"] = np.einsum("tub,tab->ua", both, d_a, optimize=True)
    d_both = weights[:, None, :] * d_pooled + p["wa"] @ d_a
    length, width = rows.shape
    turned = np.stack([p["uf"], p["ub"]])
    d_u, d_h = np.zeros_like(turned), np.zeros((2, h, width), np.float32)
    d_x = np.empty((length, 2, 3 * h, width), np.float32)
    d_hu = np.empty((2, 3 * h, width), np.float32)
    split = d_both.reshape(length, 2, h, width)
    for k in range(length)[::-1]:
        ends = [k, length - 1 - k]
        state, z, r, n, hun = trace[k]
        there = mask[ends, None]
        d_h += split[ends, [0, 1]]
        new = d_h * there
        d_n = new * (1 - z)
        d_z = (state - n) * d_n
        d_z *= z
        d_n *= 1 - n * n
        d_r = d_n * hun
        d_r *= r * (1 - r)
        d_hu[:, :h], d_hu[:, h : 2 * h] = d_z, d_r
        np.multiply(d_n, r, out=d_hu[:, 2 * h :])
        for d, t in enumerate(ends):
            d_x[t, d, :h], d_x[t, d, h : 2 * h], d_x[t, d, 2 * h :] = d_z[d], d_r[d], d_n[d]
        d_u += state @ d_hu.transpose(0, 2, 1)
        d_h *= ~there
        d_h += new * z
        d_h += turned @ d_hu
    g["uf"], g["ub"] = d_u
    each = d_x.reshape(length, 6 * h, width).transpose(0, 2, 1)[mask]
    flat = rows[mask]
    order = np.argsort(flat, kind="stable")
    d_gates = np.zeros((len(x), 6 * h), np.float32)
    begin = np.flatnonzero(np.diff(flat[order], prepend=-1))
    d_gates[flat[order][begin]] = np.add.reduceat(each[order], begin)
    g["wx"], g["bx"] = x.T @ d_gates, d_gates.sum(axis=0)
    d_in = d_gates @ p["wx"].T
    g["words"] = np.zeros_like(p["words"])
    np.add.at(g["words"], words, d_in[:, :WORD_DIM])
    each = np.ascontiguousarray((d_in[:, WORD_DIM:] / counts[:, None].astype(np.float32)).T)
    owner = np.repeat(np.arange(len(counts)), counts)
    sums = [np.bincount(slots, line[owner], len(p["chars"])) for line in each]
    g["chars"] = np.stack(sums, axis=1).astype(np.float32)
    return g


def _fit_windows(net: Network, windows, targets, vocabulary, epochs: int, seed: int) -> None:
    """Adam over shuffled windows. ``vocabulary``: known id, slots and slot count of each word row."""
    ids, slots, counts = vocabulary
    begin = np.cumsum(counts) - counts
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    step, a_round = 0, -(-len(windows) // BATCH)
    for _ in range(max(epochs, -(-LEAST_STEPS // a_round))):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            used, local = np.unique(windows[pick], return_inverse=True)
            local = local.reshape(len(pick), WINDOW)
            if used[0] < 0:
                used, local = used[1:], local - 1
            if not len(used):
                continue
            n = counts[used]
            own = np.repeat(begin[used] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            g = gradients(net, local, targets[pick], ids[used], slots[own], n)
            step += 1
            scale = np.float32(RATE * np.sqrt(1 - 0.99**step) / (1 - 0.9**step))
            for k, grad in g.items():
                # 0.9 and 0.99 of what was, in place.
                m[k] *= np.float32(0.9)
                m[k] += np.float32(0.1) * grad
                np.square(grad, out=grad)
                grad *= np.float32(0.01)
                v[k] *= np.float32(0.99)
                v[k] += grad
                np.sqrt(v[k], out=grad)
                grad += np.float32(1e-7)
                np.divide(m[k], grad, out=grad)
                grad *= scale
                net.p[k] -= grad


def features(best: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Of a text: its strongest window's logit, the logarithm of its number of windows, 1."""
    return np.stack([np.clip(best, FLOOR, -FLOOR), np.log(count), np.ones(len(best))], axis=1)


def _calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic curve over the features by damped Newton steps, held to moderate slopes."""
    w, held = np.zeros(x.shape[1]), np.diag([1.0, 1.0, 0.01])
    loss = lambda w: np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ w)).sum() + w @ held @ w / 2
    for _ in range(60):
        q = _sigmoid(x @ w)
        hessian = x.T @ (x * (q * (1 - q))[:, None]) + held
        step = np.linalg.solve(hessian, x.T @ (y - q) - held @ w)
        while np.abs(step).max() > 1e-9 and loss(w + step) > loss(w):
            step = step / 2
        w = w + step
        if np.abs(step).max() <= 1e-9:
            break
    return w


def train(sample: list[tuple[bytes, int]], share: float | None = None, seed: int = 7) -> Network:
    """Fit the network on windows of the sample, then the curve on a quarter it has not seen.

    At first every window has its text's label. Then only those windows of a
    toxic text that the network finds toxic, at least the strongest, keep it,
    and the training goes on. ``share`` of label 1 sets the curve's base rate.
    """
    split = [words_of(t.decode("utf-8", "replace")) for t, _ in sample]
    tokens = [[normalised(w) for w in s] for s in split]
    labels = np.array([y for _, y in sample], np.float32)
    learn = np.array([i % 4 != 0 for i in range(len(sample))], bool)
    seen = Counter(w for words, k in zip(tokens, learn, strict=True) if k for w in set(words))
    vocabulary = sorted((w for w, n in seen.items() if n >= 5), key=lambda w: (-seen[w], w))
    net = start(vocabulary[:KNOWN_WORDS], seed)
    words = sorted({w for s in tokens for w in s})
    if not words or len(set(labels.tolist())) < 2:
        net.curve = np.array([0.0, 0.0, 4.0 if len(labels) and labels.all() else -4.0])
        return net
    row = {w: i for i, w in enumerate(words)}
    table = np.array([net.known.get(w, 0) for w in words]), *char_slots(words)
    parts = [window_rows(np.array([row[w] for w in s], np.int32)) for s in tokens]
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    windows = np.concatenate(parts)
    used = learn[owner]
    target = labels[owner].copy()
    # Toxic windows are few beside clean ones, of which a share is enough.
    rng = np.random.default_rng(seed)

    def chosen() -> np.ndarray:
        yes, no = np.flatnonzero(used & (target > 0)), np.flatnonzero(used & (target == 0))
        return np.concatenate([yes, rng.permutation(no)[: max(CLEAN_WINDOWS * len(yes), 200)]])

    pick = chosen()
    _fit_windows(net, windows[pick], target[pick], table, EPOCHS, seed)
    for again in range(2):
        logits = window_scores(net, net.gates(words), windows)
        best = np.full(len(parts), -np.inf)
        np.maximum.at(best, owner, logits)
        target = labels[owner] * ((logits > 0) | (logits >= best[owner]))
        pick = chosen()
        _fit_windows(net, windows[pick], target[pick].astype(np.float32), table, EPOCHS - 1, seed + 1 + again)
    logits = window_scores(net, net.gates(words), windows)
    best = np.full(len(parts), -np.inf)
    np.maximum.at(best, owner, logits)
    x = features(best, np.array([len(p) for p in parts]))[~learn]
    y = labels[~learn]
    if len(set(y.tolist())) == 2:
        net.curve = _calibrate(x, y)
        if share:
            now = float(y.mean())
            net.curve[2] += np.log(share / (1 - share)) - np.log(now / (1 - now))
    return net


class Scorer:
    """Scores texts with the gate inputs of words kept between batches."""

    def __init__(self, net: Network):
        self.net, self.rows = net, {}
        self.gates = np.empty((0, 6 * HIDDEN), np.float32)

    def _add(self, tokens: list[str]) -> None:
        held = len(self.rows)
        fresh = self.net.gates([normalised(t) for t in tokens])
        if held + len(fresh) > len(self.gates):
            wider = np.empty((max(2 * len(self.gates), held + len(fresh)), 6 * HIDDEN), np.float32)
            wider[:held] = self.gates[:held]
            self.gates = wider
        self.gates[held : held + len(fresh)] = fresh
        self.rows.update(zip(tokens, range(held, held + len(fresh)), strict=True))

    def score(self, rows: list[str]) -> np.ndarray:
        split = [words_of(t) for t in rows]
        get = self.rows.get
        if new := {w for s in split for w in s if w not in self.rows}:
            if len(self.rows) > KEPT_WORDS:
                self.rows.clear()
                new = {w for s in split for w in s}
            self._add([*new])
        parts = [window_rows(np.fromiter(map(get, s), np.int32, len(s))) for s in split]
        counts = np.array([len(p) for p in parts])
        logits = window_scores(self.net, self.gates, np.concatenate(parts)) if len(self.rows) else np.full(counts.sum(), FLOOR)
        best = np.maximum.reduceat(logits, np.cumsum(counts) - counts)
        best = np.where([bool(s) for s in split], best, FLOOR)
        return _sigmoid(features(best, counts) @ self.net.curve)


_scorers: dict[str, Scorer] = {}


def classify(docs: DataFrame, net: Network, threshold: float = 0.3) -> DataFrame:
    """``doc_id, score, predicted`` of every row.

    Null and empty texts, and those without a word, get the score of no window. Texts of any length are
    read whole, in overlapping windows. Repeated rows are scored alike and null ids stay; an empty
    table gives an empty result; other columns, also those named like results, are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # bounded by the constants above
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        if net.key not in _scorers:
            _scorers.clear()
            _scorers[net.key] = Scorer(net)
        scorer = _scorers[net.key]
        for batch in batches:
            scores = scorer.score(texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    scored = map_batches(docs.select("doc_id", "text"), work, f"doc_id {id_type}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out() -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Network:
    """A network learned from a bounded sample of labelled rows that are not held out.

    Rows without a label are left out; a document labelled twice counts twice, also if its labels differ.
    Without labels of both classes every text gets the same score.
    """
    learn = F.coalesce(~held_out(), F.lit(False))
    sample = labelled_sample(docs, labels, label, learn, SAMPLE_TEXTS, SAMPLE_BYTES)
    share = labels.where(learn).agg(F.avg(F.col(label).cast("double"))).first()[0]
    return train(sample, share if share and 0 < share < 1 else None)
