"""Personal data: patterns propose spans, check sums confirm them, nearby words weigh them.

Every pattern is anchored on a literal or at the start of a run, so a text of
any length takes time in proportion to its length. Of the base kinds every
confirmed span stays, whatever stands around it; spans of the other kinds need
a score, which check sums and words of context raise or lower.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revtext.llm.batches import map_batches, texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "local_phone")
THRESHOLD = 0.5
#: Characters on either side that count as context.
NEAR = 40

# The base patterns, here free of retries, and the words that mark personal data.
_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_ALNUM = _LOCAL - frozenset("._%+-")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])\(?0[0-9]{1,4}\)?[ /-][0-9]{2,4}(?:[ -][0-9]{2,4}){1,3}(?![0-9-])")
_CONTEXT = {
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta", "transfer"),
    "ssn": ("ssn", "social", "security", "insurance", "taxpayer"),
    "local_phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "téléphone", "teléfono"),
}
_AGAINST = ("isbn", "order", "invoice", "part", "serial", "version", "example")
_PRIOR = {"iban": 0.3, "ssn": 0.35, "local_phone": 0.3}
_CHECKED, _WORD_FOR, _WORD_AGAINST = 0.4, 0.3, -0.3


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each ``@`` with a domain behind it takes the run before it, back to the last match."""
    free = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            free = m.end()


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        # A part of over three digits may still be small: leading zeros.
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() <= 40 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m[0])) <= 15:
            yield m.span()


def _weighed(text: str, kind: str, start: int, end: int, checked: bool) -> float:
    around = f"{text[max(0, start - NEAR) : start]} {text[end : end + NEAR]}".lower()
    words = set(re.findall(r"[^\W\d_]+", around))
    score = _PRIOR[kind] + _CHECKED * checked
    score += _WORD_FOR * bool(words & {*_CONTEXT[kind]}) + _WORD_AGAINST * bool(words & {*_AGAINST})
    return min(1.0, max(0.0, score))


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """The longest reading of each start that ends with a word and has a right check sum.

    What follows a number may look like a part of it, so shorter readings are
    tried; behind a start without any, the search goes on.
    """
    at = 0
    while m := _IBAN.search(text, at):
        at = m.start() + 1
        for end in range(m.end(), m.start() + 14, -1):
            if text[end - 1] == " " or (end < len(text) and text[end] in _ALNUM):
                continue
            found = text[m.start() : end].replace(" ", "")
            if len(found) < 15:
                break
            if mod97(found):
                yield m.start(), end
                at = end
                break


def _others(text: str, taken: list[Span]) -> list[Span]:
    """Spans of the further kinds that overlap none of ``taken``, nor each other."""
    out, covered = [], bytearray()
    finders = (("iban", _ibans), ("ssn", _SSN), ("local_phone", _LOCAL_PHONE))
    for kind, finder in finders:
        spans = finder(text) if kind == "iban" else (m.span() for m in finder.finditer(text))
        for start, end in spans:
            if not covered:
                covered = bytearray(len(text))
                for s in taken:
                    covered[s.start : s.end] = b"\1" * (s.end - s.start)
            if 1 in covered[start:end]:
                continue
            score = _weighed(text, kind, start, end, kind == "iban")
            if score >= THRESHOLD:
                covered[start:end] = b"\1" * (end - start)
                out.append(Span(kind, start, end, score))
    return out


def find_spans(text: str) -> list[Span]:
    """All spans of ``text`` by start, then kind as listed; code points, end exclusive."""
    found: list[Span] = []
    if "@" in text:
        found += (Span("email", a, b, 1.0) for a, b in _emails(text))
    if any(d in text for d in "0123456789"):
        for kind, finder in (("ip", _ips), ("card", _cards), ("phone", _phones)):
            found += (Span(kind, a, b, 1.0) for a, b in finder(text))
        found += _others(text, found)
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


def redact(text: str, spans: list[Span]) -> str:
    """``text`` with spans replaced by their kind in brackets; overlapping ones become the first's."""
    out, at = [], 0
    for span in spans:
        if span.start >= at:
            out += (text[at : span.start], f"[{span.kind.upper()}]")
        at = max(at, span.end)
    return "".join(out) + text[at:]


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, end, score) of every row of ``docs``.

    A null or empty text has no spans. Repeated rows come out repeated; an
    empty table gives an empty result; other columns are not read.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    kind = pa.list_(
        pa.struct(
            [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]
        )
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[s._asdict() for s in find_spans(t)] for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"]
            )

    span = "struct<kind:string,start:bigint,end:bigint,score:double>"
    return map_batches(docs.select("doc_id", "text"), work, f"doc_id {id_type}, spans array<{span}>")


def digest(found: DataFrame) -> DataFrame:
    """Counts per base kind and the spans as text."""

    def joined(spans):
        each = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.concat_ws(",", each)

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


def redacted(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with personal data in ``text`` replaced, and ``n_chars`` counted anew.

    Rows without findings come out as they were; null texts stay null.
    """
    names = docs.columns
    at = names.index("text")
    size = names.index("n_chars") if "n_chars" in names else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [*batch.columns]
            old = batch.column(at).to_pylist()
            new = [t and redact(t, find_spans(t)) for t in old]
            columns[at] = pa.array(new, batch.column(at).type)
            if size is not None:
                counts = zip(old, new, batch.column(size).to_pylist(), strict=True)
                fixed = [n if a == b else len(b) for a, b, n in counts]
                columns[size] = pa.array(fixed, batch.column(size).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_batches(docs, work, kinds)
