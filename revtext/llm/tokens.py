"""Token ids of whole texts through a public tokenizer, with a cache of words.

Texts are cut in their bytes where the byte-level pre-tokenizer always cuts:
before a single space, around a single line end, and between ASCII letters and
punctuation, apostrophes aside. Only the distinct units of a batch are looked up, and
the ids of the batch are gathered from theirs. Texts that hold an added token
of the tokenizer, which may end anywhere, or white space beyond ASCII are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

if TYPE_CHECKING:
    from tokenizers import Tokenizer

#: Rows of a batch of texts to encode: the more at once, the fewer distinct units.
ENCODED_ROWS = 1_000
#: Bytes of texts that are encoded together, where a task has that many.
ENCODED_BYTES = 4 << 20
#: Units of the cache; when it is full, those that were not met again since it was full last go.
CACHE_ENTRIES = 500_000
#: New units encoded in one text.
TOGETHER = 20_000
#: Longer units are encoded each time.
CACHE_BYTES = 48

#: White space that is one byte, and white space that is more or rare.
_ASCII_SPACE = b" \t\n\x0b\x0c\r"
_OTHER_SPACE = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

#: Kinds of bytes: white space, letters, punctuation that no letter can follow in one unit, others.
_SPACE, _LETTER, _SIGN, _REST = range(4)

_LINE = r"\A ?[^ \t\n\x0b\x0c\r]+\z"
#: Latin letters up to U+017F, which the pre-tokenizer leaves whole.
_WORD = r"\A ?[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{17f}]+\z"

_encoders: dict[str, Encoder] = {}


def _byte_kinds() -> np.ndarray:
    kinds = np.full(256, _REST, np.uint8)
    kinds[list(b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~')] = _SIGN
    kinds[ord("a") : ord("z") + 1] = _LETTER
    kinds[ord("A") : ord("Z") + 1] = _LETTER
    kinds[list(_ASCII_SPACE)] = _SPACE
    return kinds


_KIND = _byte_kinds()


def _byte_characters() -> np.ndarray:
    """The character that stands for each byte in the vocabulary of a byte-level model."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    points = np.zeros(256, "<u4")
    points[shown] = shown
    points[points == 0] = 256 + np.arange(256 - len(shown))
    return points


_CHARACTER = _byte_characters()


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> Encoder:
    """The encoder of ``path``; a worker keeps it from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def unit_starts(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where units begin in the bytes of texts, which begin and end at ``edges``; texts begin units."""
    kind = _KIND[data]
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 2:
        before, here, after = kind[:-2], kind[1:-1], kind[2:]
        # A text that ends or begins beside a white space is no neighbour of it.
        lone = (here == _SPACE) & (before != _SPACE) & (after != _SPACE)
        inner = edges[(edges > 0) & (edges < len(data))]
        for beside in (inner, inner - 1):
            beside = beside[(beside >= 1) & (beside < len(data) - 1)]
            lone[beside - 1] = False
        middle = data[1:-1]
        cut[1:-2] |= lone & ((middle == 32) | (middle == 10))
        cut[2:-1] |= lone & (middle == 10)
    if len(data) > 1:
        cut[1:-1] |= (kind[:-1] == _LETTER) & (kind[1:] == _SIGN)
        cut[1:-1] |= (kind[:-1] == _SIGN) & (kind[1:] == _LETTER)
    cut[edges] = True
    cut[-1] = False
    return np.flatnonzero(cut)


def _spread(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places from ``begin`` on, ``sizes`` of them each, all in a row."""
    upto = np.cumsum(sizes, dtype=np.int32)
    place = np.repeat(begin - upto + sizes, sizes)
    place += np.arange(len(place), dtype=np.int32)
    return place


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Known units, and where in ``ids`` theirs begin, how many there are, whether the unit was met again.
        self.units = pa.array([], pa.binary())
        self.ids = np.empty(0, self.dtype)
        self.begin = self.sizes = np.empty(0, np.int32)
        self.met = np.empty(0, bool)
        self.words = self._of_words()
        self.line_end = self.tokenizer.token_to_id("Ċ")

    def _of_words(self) -> Tokenizer | None:
        """The same model without the search for words, for words a line; None if words may be cut otherwise."""
        from tokenizers import Tokenizer, pre_tokenizers

        made = json.loads(self.tokenizer.to_str())
        before = made["pre_tokenizer"] or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        if made["normalizer"] or not plain:
            return None
        words = Tokenizer.from_str(json.dumps(made | {"added_tokens": [], "post_processor": None}))
        words.pre_tokenizer = pre_tokenizers.Split("Ċ", "isolated")
        return words

    def encode(self, texts: pa.Array | list[str]) -> list[np.ndarray]:
        """Ids of each text, null as empty, without special tokens."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        column = pc.fill_null(column, "")
        whole = pc.match_substring_regex(column, _OTHER_SPACE)
        for added in self.added:
            whole = pc.or_(whole, pc.match_substring(column, added))
        out = self._by_units(pc.if_else(whole, "", column))
        for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
            out[i] = np.frombuffer(self._ids(column[i].as_py()), self.dtype)
        return out

    def _ids(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _by_units(self, column: pa.Array) -> list[np.ndarray]:
        joined = pa.concat_arrays([column.cast(pa.binary())])  # without the offset of a slice
        offsets = np.frombuffer(joined.buffers()[1], np.int32)[joined.offset :][: len(joined) + 1]
        first, last = int(offsets[0]), int(offsets[-1])
        if first == last:
            return [np.empty(0, self.dtype)] * len(joined)
        raw = joined.buffers()[2]
        edges = (offsets - first).astype(np.int64)
        starts = unit_starts(np.frombuffer(raw, np.uint8)[first:last], edges)
        bounds = np.append(starts, last - first).astype(np.int32) + np.int32(first)
        units = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), raw])
        coded = units.dictionary_encode()
        # A batch is far below 2 ** 31 ids.
        pool, begin, sizes = self._known(coded.dictionary)
        at = coded.indices.to_numpy()
        own = sizes[at]
        upto = np.cumsum(own, dtype=np.int32)
        ids = pool[_spread(begin[at], own)]
        # Ids before the unit at which each text begins.
        ends = np.append(0, upto)[np.searchsorted(starts, edges)]
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def _known(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct units: a pool of ids, and for each unit where its ids begin there and how many there are."""
        at = pc.fill_null(pc.index_in(units, value_set=self.units), -1).to_numpy()
        held, new = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        self.met[at[held]] = True
        fresh = units.take(pa.array(new))
        ids, at_new, sizes_new = self._encoded(fresh)
        at_new += np.int32(len(self.ids))
        pool = np.concatenate([self.ids, ids])
        begin, sizes = np.empty(len(units), np.int32), np.empty(len(units), np.int32)
        begin[held], sizes[held] = self.begin[at[held]], self.sizes[at[held]]
        begin[new], sizes[new] = at_new, sizes_new
        self._keep(fresh, pool, at_new, sizes_new)
        return pool, begin, sizes

    def _keep(self, fresh: pa.Array, pool: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> None:
        short = np.flatnonzero(pc.binary_length(fresh).to_numpy() <= CACHE_BYTES)
        old = np.arange(len(self.units))
        if len(old) + len(short) > CACHE_ENTRIES:
            old = np.flatnonzero(self.met)
            self.met[:] = False
        if len(old) + len(short) > CACHE_ENTRIES:
            old, short = old[:0], short[:CACHE_ENTRIES]
        begin = np.concatenate([self.begin[old], begin[short]])
        self.sizes = np.concatenate([self.sizes[old], sizes[short]])
        self.ids = pool[_spread(begin, self.sizes)]
        self.begin = np.cumsum(self.sizes, dtype=np.int32) - self.sizes
        self.met = np.concatenate([self.met[old], np.zeros(len(short), bool)])
        kept = self.units if len(old) == len(self.units) else self.units.take(pa.array(old))
        self.units = pa.concat_arrays([kept, fresh.take(pa.array(short))])

    def _encoded(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``_known``, for units that are encoded together, in one text with a unit per line."""
        begin, sizes = np.empty(len(units), np.int32), np.empty(len(units), np.int32)
        texts, pools, ahead = units.cast(pa.string()), [np.empty(0, self.dtype)], 0
        is_line = pc.match_substring_regex(texts, _LINE).to_numpy(zero_copy_only=False)
        is_word = pc.match_substring_regex(texts, _WORD).to_numpy(zero_copy_only=False) & (self.words is not None)
        for kind, are_words in ((is_word, True), (is_line & ~is_word, False)):
            picked = np.flatnonzero(kind)
            for k in range(0, len(picked), TOGETHER):
                some = picked[k : k + TOGETHER]
                ids, first, count = self._together(units.take(pa.array(some)), are_words)
                begin[some], sizes[some] = first + ahead, count
                pools.append(ids)
                ahead += len(ids)
        for i in np.flatnonzero(~is_line & ~is_word).tolist():
            ids = np.frombuffer(self._ids(texts[i].as_py()), self.dtype)
            begin[i], sizes[i] = ahead, len(ids)
            pools.append(ids)
            ahead += len(ids)
        return np.concatenate(pools), begin, sizes

    def _together(self, units: pa.Array, are_words: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lines = pa.ListArray.from_arrays(pa.array([0, len(units)], pa.int32()), units)
        joined = pc.binary_join(lines, b"\n")[0].as_py()
        if are_words:
            tokenizer, text = self.words, _CHARACTER[np.frombuffer(joined, np.uint8)].tobytes().decode("utf-32-le")
        else:
            tokenizer, text = self.tokenizer, joined.decode()
        found = tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        ids = np.frombuffer(array(self.code, found).tobytes(), self.dtype)
        at = np.flatnonzero(ids == self.line_end).astype(np.int32)
        if len(at) == len(units) - 1:
            first = np.append(np.int32(0), at + np.int32(1))
            return ids, first, np.append(at, np.int32(len(ids))) - first
        each = [np.frombuffer(self._ids(unit.decode()), self.dtype) for unit in units.to_pylist()]
        count = np.array([len(x) for x in each], np.int32)
        return np.concatenate(each), np.cumsum(count, dtype=np.int32) - count, count
