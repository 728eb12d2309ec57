"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Base kinds are `email`, `ip`, `card` (Luhn) and `phone`; they are always reported.  Further kinds need a
checksum or a context word: `iban` (mod-97), `ssn` (3-2-4 digits beside a word such as "social") and
`local_phone` (digits without a plus sign beside a word such as "call").  A span's score starts from its
kind's prior; a context word within `CONTEXT` characters before it raises the score, a word such as
"example" lowers it.  A further span is reported from `MIN_SCORE` on, if no base span covers part of it.
Each span tells whether a checksum confirmed it.  Letters, digits and word ends are ASCII ones.

Every pattern is scanned in time linear in the text: runs are possessive, and a run is only entered at its
beginning.  Defined results: a null text is empty; ids are passed on as they are, null or repeated; an empty
table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "local_phone")
BASE = KINDS[:4]
CHECKSUM = ("card", "iban")
CONTEXT = 40
MIN_SCORE = 50
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b"
#: a whole run of digits and hyphens
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
LOCAL_PHONE = r"\(?\b[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}\b"
_IBAN = re.compile(IBAN, re.A)
_SSN = re.compile(f"(?<![0-9-]){SSN}(?![0-9-])")
_LOCAL_PHONE = re.compile(LOCAL_PHONE, re.A)
_DIGIT = re.compile(r"[0-9]")
#: scores, in hundredths: each kind's prior, what a context word adds, what a word of examples takes off
PRIOR = {"email": 90, "ip": 60, "card": 80, "phone": 70, "iban": 80, "ssn": 30, "local_phone": 30}
RAISE, LOWER = 30, 25
NEAR = {
    "email": r"(?i)\b(?:e-?mail|contact|write)\b",
    "ip": r"(?i)\b(?:ip|address|host|server|login)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|payment)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax)\b",
    "iban": r"(?i)\b(?:iban|account|bank|transfer)\b",
    "ssn": r"(?i)\b(?:ssn|social|security)\b",
    "local_phone": r"(?i)\b(?:phone|tel|call|mobile|fax)\b",
}
FAKE = r"(?i)\b(?:example|sample|dummy|fake|test)\b"
_NEAR = {k: re.compile(p, re.A) for k, p in NEAR.items()}
_FAKE = re.compile(FAKE, re.A)

SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("confirmed", pa.bool_())])
SPAN_SQL = "array<struct<kind: string, start: int, end: int, score: double, confirmed: boolean>>"


#: What may not stand before a phone number without country code.
_BEFORE = tuple("0123456789+(-")


def luhn(digits: str) -> bool:
    """True if the last digit is the check digit of the others."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """True if an IBAN's check digits hold: country and check digits last, letters as 10 to 35, remainder 1."""
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _emails(text: str):
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            free = m.end()
            yield begin, free
        at = text.find("@", max(at + 1, free))


def base_spans(text: str):
    """(kind, start, end) of the base kinds, by kind, then start."""
    if "@" in text:
        for a, b in _emails(text):
            yield "email", a, b
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]  # a part may have thousands of digits
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield "phone", m.start(), m.end()


def _extra(text: str):
    for m in _IBAN.finditer(text):
        body = m[0]
        while len(body) >= 15:  # the run may have taken a following capital word
            if mod97(body):
                yield "iban", m.start(), m.start() + len(body)
                break
            cut = body.rfind(" ")
            body = body[:cut] if cut > 0 else ""
    if "-" in text:
        for m in _SSN.finditer(text):
            yield "ssn", m.start(), m.end()
    for m in _LOCAL_PHONE.finditer(text):
        if text[m.start() - 1 : m.start()] not in _BEFORE and text[m.end() : m.end() + 1] != "-":
            yield "local_phone", m.start(), m.end()


def score(text: str, kind: str, start: int) -> float:
    around = text[max(0, start - CONTEXT) : start]
    s = PRIOR[kind] + (RAISE if _NEAR[kind].search(around) else 0) - (LOWER if _FAKE.search(around) else 0)
    return min(100, max(0, s)) / 100


def merged(spans) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of sorted spans."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in spans:
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def find_pii(text: str) -> list[dict]:
    """All spans of a text, by kind as listed, then start; code points, end exclusive."""
    out = [{"kind": k, "start": a, "end": b, "score": score(text, k, a), "confirmed": k in CHECKSUM} for k, a, b in base_spans(text)]
    if _DIGIT.search(text):
        starts, ends = merged(sorted((s["start"], s["end"]) for s in out))
        for k, a, b in _extra(text):
            i = bisect.bisect_right(ends, a)  # the first taken stretch that ends behind the span's start
            if (i == len(ends) or starts[i] >= b) and (s := score(text, k, a)) * 100 >= MIN_SCORE:
                out.append({"kind": k, "start": a, "end": b, "score": s, "confirmed": k in CHECKSUM})
    return out


def _scan(batches):
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for at in range(0, len(ids), 1000):
            found = [find_pii(t or "") for t in texts.slice(at, 1000).to_pylist()]
            yield pa.RecordBatch.from_arrays([ids.slice(at, 1000), pa.array(found, pa.list_(SPAN))], ["doc_id", "spans"])


def pii(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end, score) of each row of `docs` (doc_id, text). One narrow pass, no shuffle."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scan, f"doc_id long, spans {SPAN_SQL}")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The base kinds' numbers and hash, all spans, their number, their scores in hundredths, and how many a checksum confirmed."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    scores = F.array_join(F.transform("spans", lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",")
    return found.select(
        "doc_id",
        *(count(k) for k in BASE),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
        scores.alias("scores"),
        F.size(F.filter("spans", lambda s: s["confirmed"])).cast("long").alias("n_confirmed"),
    )
