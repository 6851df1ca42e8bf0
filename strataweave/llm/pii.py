"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Cards need Luhn, IBANs mod 97, secrets (keys, tokens) a spread of characters; context words are whole words near a span. Spans of the
base kinds are always reported, those of the other kinds from a score of REPORT_AT on.

Defined results: null and empty texts give no spans; offsets are code points with an exclusive end; within one
kind spans are leftmost and never overlap; repeated rows are scanned each for themselves; an empty table gives
an empty table. Only the id and text columns are read, so other columns of any name do no harm.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare

BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("iban", "ssn", "secret")
KINDS = BASE_KINDS + EXTRA_KINDS

#: Score before context, the words that raise it, and the score a span of an extra kind needs to be reported.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.85, "ssn": 0.3, "secret": 0.3}
CONTEXT = {
    "email": ("mail", "email", "e-mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "payment"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "transfer"),
    "ssn": ("ssn", "social security", "tax id", "taxpayer"),
    "secret": ("secret", "token", "password", "passwd", "pwd", "key", "apikey", "api_key", "access_key", "credential", "credentials", "auth", "bearer"),
}
CONTEXT_CHARS = 48
CONTEXT_BONUS = 0.3
REPORT_AT = 0.5
#: Bits a character that a secret has at least.
SECRET_BITS = 3.0

_NEAR = {k: re.compile(r"(?<![a-z0-9])(?:" + "|".join(map(re.escape, w)) + r")(?![a-z0-9])") for k, w in CONTEXT.items()}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Z](?<![A-Za-z0-9][A-Z])[A-Z][0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"[0-9](?<![0-9-][0-9])[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"[A-Za-z0-9_](?<![A-Za-z0-9_+/-][A-Za-z0-9_])[A-Za-z0-9_+/-]{19,}")
_DIGITS = re.compile(r"[^0-9]+")

SPAN_TYPE = "array<struct<kind:string,start:long,end:long,score:double>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i & 1:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban[4:] + iban[:4]
    return int("".join(str(int(ch, 36)) for ch in s)) % 97 == 1


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Upper-case words may follow an IBAN, so each end of a word in the run is tried, the last first."""
    at = 0
    while m := _IBAN.search(text, at):
        ends = [m.end(), *(i for i in range(m.end() - 1, m.start() + 14, -1) if text[i] == "\x20")]
        for end in ends:
            s = text[m.start() : end].replace(" ", "")
            if 15 <= len(s) <= 34 and mod97(s):
                yield m.start(), end
                at = end
                break
        else:
            at = m.start() + 4


def spread(s: str) -> float:
    """Shannon entropy in bits a character."""
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ is looked at once: its local part is the run before it, so long runs cost linear time."""
    done = 0
    at = text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        if m:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                done = m.end()
                yield start, done
        at = text.find("@", max(at + 1, done))


def _proposals(text: str) -> Iterator[tuple[str, int, int]]:
    for s, e in _emails(text):
        yield "email", s, e
    for m in _IP.finditer(text):
        if all(len(p) < 4 and int(p or "0") <= 255 for p in (p.lstrip("0") for p in m[0].split("."))):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _DIGITS.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()
    for m in _PHONE.finditer(text):
        if 8 <= sum(ch.isdigit() for ch in m[0]) <= 15:
            yield "phone", m.start(), m.end()
    for s, e in _ibans(text):
        yield "iban", s, e
    for m in _SSN.finditer(text):
        yield "ssn", m.start(), m.end()
    for m in _SECRET.finditer(text):
        if not m[0].isalpha() and spread(m[0]) >= SECRET_BITS:
            yield "secret", m.start(), m.end()


def find_spans(text: str | None) -> list[dict]:
    """All spans of one text, by kind in the order of KINDS, then by start."""
    found = []
    for kind, start, end in _proposals(text or ""):
        near = (text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]).lower()
        score = min(1.0, PRIOR[kind] + CONTEXT_BONUS * bool(_NEAR[kind].search(near)))
        if kind in BASE_KINDS or score >= REPORT_AT:
            found.append({"kind": kind, "start": start, "end": end, "score": score})
    return found


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) for every row; one narrow pass, no shuffle."""
    prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def scan(batches):
        for b in batches:
            spans = [find_spans(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, _ARROW)], ["id", "spans"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(scan, f"id {kind}, spans {SPAN_TYPE}").select(F.col("id").alias(id_col), "spans")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with each span replaced by its kind in angle brackets; overlapping spans merge into the first."""
    prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def clean(text):
        if text is None:
            return None
        out, at = [], 0
        for s in sorted(find_spans(text), key=lambda s: (s["start"], -s["end"])):
            if s["start"] >= at:
                out += [text[at : s["start"]], f"<{s['kind'].upper()}>"]
            at = max(at, s["end"])
        return "".join([*out, text[at:]])

    def scan(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([clean(t.as_py()) for t in b.column(1)], pa.string())], ["id", "text"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(scan, f"id {kind}, text string").select(F.col("id").alias(id_col), F.col("text").alias(text_col))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest_columns(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The counts, base digest and span text of the query, derived from detect(); n_private counts all spans."""
    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    all_ = F.size("spans").cast("long").alias("n_private")
    return found.select(id_col, *map(count, BASE_KINDS), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), *map(count, EXTRA_KINDS), all_)
