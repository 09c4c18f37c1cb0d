"""Personal data: expressions propose spans, checksums confirm, nearby words weigh.

A proposed span gets its kind's prior score; a passed checksum raises it, and
context words within `reach` characters raise or lower it. Spans of the base
kinds that pass their check are always reported; those of other kinds when
their score reaches `threshold`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm.common import extend, free_name, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match starts where its run of digits starts, as the first part takes them all.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[a-z]+")

#: Score before any evidence, after a passed checksum (None: no checksum).
PRIOR = {"email": (0.9, None), "ip": (0.6, None), "card": (0.3, 0.8), "phone": (0.5, None), "iban": (0.3, 0.9), "ssn": (0.3, None)}
#: Words that speak for and against a kind.
CONTEXT = {
    "email": ({"mail", "email", "contact", "write"}, set()),
    "ip": ({"ip", "address", "host", "server", "login"}, {"version", "release", "section"}),
    "card": ({"card", "visa", "mastercard", "credit", "payment"}, {"isbn", "order", "serial"}),
    "phone": ({"phone", "call", "tel", "mobile", "fax"}, {"version", "score"}),
    "iban": ({"iban", "bank", "account", "transfer"}, {"serial"}),
    "ssn": ({"ssn", "social", "security", "taxpayer"}, {"part", "serial", "isbn"}),
}
CONTEXT_WEIGHT = 0.35
REACH = 48


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def mod97(code: str) -> bool:
    rest = 0
    for c in code[4:] + code[:4]:
        rest = int(f"{rest}{int(c, 36)}") % 97
    return rest == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @, dotted domain; each `@` is tried once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        # The part before the next @ can't reach back over this one.
        done = max(done, at + 1)
        at = text.find("@", done)


def _digits(x: str) -> str:
    return "".join(c for c in x if c in "0123456789")


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans that pass their kind's expression and check, by kind and start."""
    if "@" in text:
        for a, b in emails(text):
            yield "email", a, b
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) < 3 or len(p) == 3 and p <= "255" for part in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 37 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                yield "phone", m.start(), m.end()
    for m in _IBAN.finditer(text):
        if 15 <= len(code := m[0].replace(" ", "")) <= 34 and mod97(code):
            yield "iban", m.start(), m.end()
    for m in _SSN.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield "ssn", m.start(), m.end()


def score(text: str, kind: str, start: int, end: int) -> float:
    prior, confirmed = PRIOR[kind]
    near = set(_WORD.findall(f"{text[max(0, start - REACH) : start]} {text[end : end + REACH]}".lower()))
    pro, con = CONTEXT[kind]
    got = (prior if confirmed is None else confirmed) + CONTEXT_WEIGHT * (bool(near & pro) - bool(near & con))
    return min(1.0, max(0.0, got))


def spans_of(text: str | None, threshold: float = 0.6) -> list[Span]:
    """All reported spans by kind, then start; none for null and empty texts."""
    if not text:
        return []
    found = (Span(k, a, b, round(score(text, k, a, b), 3)) for k, a, b in proposals(text))
    return [s for s in found if s.kind in BASE or s.score >= threshold]


def find_pii(docs: DataFrame, *, text_col: str = "text", name: str = "pii", threshold: float = 0.6) -> DataFrame:
    """`docs` with column `name`: array of (kind, start, end, score), code points, end exclusive.

    Null and empty texts have no spans. Spans of different kinds may overlap.
    Each row stands alone: repeated rows repeat their spans, other columns
    stay. If `name` is taken, the new column has underscores before it.
    """
    place, name = docs.columns.index(text_col), free_name(docs, name)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def compute():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array([[vars(s) for s in spans_of(t, threshold)] for t in batch.column(place).to_pylist()], kind)]

        return work

    return extend(docs, f"`{name}` array<struct<kind:string,start:long,end:long,score:double>>", compute)


def mask_pii(docs: DataFrame, *, text_col: str = "text", threshold: float = 0.6) -> DataFrame:
    """`docs` with each reported span replaced by its kind in brackets; overlapping spans become one.

    Null texts stay null, empty ones empty; repeated rows are masked alike, and
    all other columns stay, whatever their names. No rows give no rows.
    """
    place, made = docs.columns.index(text_col), free_name(docs, "masked")

    def masked(text: str | None) -> str | None:
        out, at = [], 0
        for s in sorted(spans_of(text, threshold), key=lambda s: (s.start, -s.end)):
            if s.start >= at:
                out += [text[at : s.start], f"[{s.kind}]"]
            at = max(at, s.end)
        return "".join([*out, text[at:]]) if out else text

    def compute():
        return lambda batch: [pa.array(map(masked, batch.column(place).to_pylist()), pa.string())]

    return extend(docs, f"`{made}` string", compute).withColumn(text_col, F.col(f"`{made}`")).drop(made)


def _joined(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all documents, counted by kind and digested; null texts have none."""
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in BASE]
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("pii")).alias("spans"))
