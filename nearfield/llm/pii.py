"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Kinds, in the order that breaks ties of start: ``email``, ``ip``, ``card`` and
``phone`` are the base and stay whatever their score; ``iban`` (mod-97),
``short_card`` (12 or 13 digits passing Luhn), ``ssn`` and ``local_phone`` are
kept only if their score, moved by the words around them, reaches a bound.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.store import ready
from nearfield.llm.textops import slices

KINDS = ("email", "ip", "card", "phone", "iban", "short_card", "ssn", "local_phone")
BASE = 4

# fixed values: the patterns of the base kinds
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# the method's own
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
LOCAL = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9])")
DIGITS = re.compile(r"[0-9]")
LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Words that raise the score of a kind nearby, and words that lower any.
HINTS = {
    "email": ("mail", "email", "contact", "courriel", "correo"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "credit", "carte", "karte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "teléfono", "téléphone"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "short_card": ("card", "credit", "visa", "carte", "karte", "tarjeta"),
    "ssn": ("ssn", "social", "security"),
    "local_phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "teléfono", "téléphone"),
}
AGAINST = ("isbn", "version", "order", "sample", "example", "invoice", "serial", "doi")
START = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.8, "iban": 0.9, "short_card": 0.4, "ssn": 0.4, "local_phone": 0.4}
RAISED, LOWERED, NEEDED, NEAR = 0.3, 0.3, 0.6, 40
WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def mod97(text: str) -> bool:
    """The check of an IBAN: first four characters last, letters as 10 to 35, remainder 1."""
    joined = text.replace(" ", "")
    if not 15 <= len(joined) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in joined[4:] + joined[:4])) % 97 == 1


def _score(text: str, kind: str, start: int, end: int) -> float:
    around = {w.lower() for w in WORD.findall(text[max(0, start - NEAR) : start]) + WORD.findall(text[end : end + NEAR // 2])}
    score = START[kind] + RAISED * any(w in around for w in HINTS[kind]) - LOWERED * any(w in around for w in AGAINST)
    return min(1.0, max(0.0, round(score, 3)))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of EMAIL; looks only at the stretches before an @ sign, so it is linear."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_PART:
            start -= 1
        found = EMAIL.match(text, start) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)`` with parts of at most 255.

    Such a match begins where digits and dots begin, or after four parts, so
    stretches of parts are read once; the pattern itself tries every digit of a
    long number.
    """
    for m in DOTTED.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x := p.lstrip("0")) <= 3 and int(x or "0") <= 255 for p in four):
                yield at, end
            at = end + 1


class Taken:
    """Spans that are taken, to see what overlaps them."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends, self.far = [], [], []
        for a, b in sorted(spans):
            self.starts.append(a)
            self.ends.append(b)
            self.far.append(max(b, self.far[-1] if self.far else b))

    def free(self, start: int, end: int, around: bool = False) -> bool:
        """Whether no span overlaps start to end; with ``around``, but for spans that lie within."""
        i = bisect.bisect_left(self.starts, end) - 1
        while i >= 0 and self.far[i] > start:
            if self.ends[i] > start and not (around and start <= self.starts[i] and self.ends[i] <= end):
                return False
            i -= 1
        return True


def find(text: str) -> list[Span]:
    """All spans of a text, by start and then kind; ends are exclusive, in code points.

    A span of the other kinds doesn't overlap one of the base; only an IBAN may
    have some within it, since its digits can look like a card's.
    """
    out: list[tuple[str, int, int]] = []
    if "@" in text:
        out += [("email", a, b) for a, b in emails(text)]
    if DIGITS.search(text):
        if "." in text:
            out += [("ip", a, b) for a, b in addresses(text)]
        short = []
        for m in CARD.finditer(text):
            if m.end() - m.start() < 12:
                continue
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
            elif 12 <= len(digits) <= 13 and luhn(digits):
                short.append(("short_card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= sum(c in "0123456789" for c in m[0]) <= 15]
        taken = Taken([(a, b) for _, a, b in out])
        free = lambda m: taken.free(m.start(), m.end())
        out += [s for s in short if taken.free(*s[1:])]
        out += [("iban", m.start(), m.end()) for m in IBAN.finditer(text) if mod97(m[0]) and taken.free(m.start(), m.end(), True)]
        if "-" in text:
            out += [("ssn", m.start(), m.end()) for m in SSN.finditer(text) if free(m) and m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000"]
        out += [("local_phone", m.start(), m.end()) for m in LOCAL.finditer(text) if free(m)]
    spans = [Span(kind, a, b, _score(text, kind, a, b)) for kind, a, b in out]
    kept = [s for s in spans if KINDS.index(s.kind) < BASE or s.score >= NEEDED]
    return sorted(kept, key=lambda s: (s.start, KINDS.index(s.kind)))


SPANS = "array<struct<kind: string, start: long, end: long, score: double>>"
_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        found = [find(t or "") for t in batch.column("text").to_pylist()]
        rows = [[{"kind": s.kind, "start": s.start, "end": s.end, "score": s.score} for s in spans] for spans in found]
        base = [",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans if KINDS.index(s.kind) < BASE) for spans in found]
        yield pa.record_batch({"id": batch.column("id"), "spans": pa.array(rows, _TYPE), "base_sha256": [hashlib.sha256(b.encode()).hexdigest() for b in base]})


def personal_data(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, spans, base_sha256``: one row for each row; spans have kind, start, end (code points, exclusive) and score.

    Base kinds are leftmost and non-overlapping within a kind, and a match that
    fails its check is dropped without a retry. ``base_sha256`` is the digest of
    the base spans. Null and empty texts have no spans. Repeated rows and null
    ids give a row each; other columns are not read.
    """
    ready(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(_run, f"id {kind}, spans {SPANS}, base_sha256 string")
