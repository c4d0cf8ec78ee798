"""Personal data: patterns propose, checksums confirm, nearby words adjust the score.

Base kinds are e-mail addresses, IPv4 addresses, payment cards (14 to 19 digits passing the
Luhn check) and international phone numbers (10 to 15 digits); each is matched leftmost and
without overlaps, and a match that fails its check is dropped. Further kinds are account
numbers with a valid mod-97 remainder (IBAN), and two that need a context word nearby:
national phone numbers and social security numbers. Further spans never overlap base spans.

Every span has a score: its kind's prior, raised by a passed checksum, raised or lowered by
words within ``REACH`` characters. Base spans are reported whatever their score; further
spans from ``MIN_SCORE`` on.

The work of a text is linear in its length. Texts without a digit and without an at sign are
not decoded at all.

Defined results: a null or empty text has no spans; texts of any length are read whole;
repeated rows are reported as often as they occur; an empty table gives an empty result; columns
that are not asked for are not read.
Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.batches import bound_batches
from lectern.llm.textkit import slices

BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("iban", "phone_national", "ssn")
REACH = 40
IBAN_LEAST = 15  # characters, what the pattern asks for
MIN_SCORE = 0.6

# The patterns. Look-behinds only keep a scan from starting inside a run that it
# has already tried from its beginning; they do not change what matches.
_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_NATIONAL = re.compile(
    r"(?<![0-9+.-])(?:\([0-9]{2,4}\)[\x20-]?|0?[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-])"
)
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

# Words that speak for a kind, and words that speak against any.
_FOR = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write)\b", re.I),
    "ip": re.compile(r"\b(?:ip|address|host|server|login)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|mastercard|amex|credit|payment|pay)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|telephone|call|mobile|cell|fax|contact)\b", re.I),
    "iban": re.compile(r"\b(?:iban|account|bank|konto|cuenta|compte)\b", re.I),
    "phone_national": re.compile(r"\b(?:phone|tel|telephone|call|mobile|cell|fax)\b", re.I),
    "ssn": re.compile(r"\b(?:ssn|social security)\b", re.I),
}
_AGAINST = re.compile(r"\b(?:version|isbn|invoice|order|serial|ticket|build|release)\b", re.I)
_PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.4, "phone": 0.6, "iban": 0.4, "phone_national": 0.4, "ssn": 0.4}
_CHECKSUM, _CONTEXT = 0.4, 0.3


def luhn(digits: str) -> bool:
    """Luhn check of a string of ASCII digits."""
    odd = sum(map(int, digits[-1::-2]))
    even = sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return (odd + even) % 10 == 0


def mod97(account: str) -> bool:
    """Whether the remainder of an account number (ISO 13616 order) is one."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    floor = 0
    at = text.find("@")
    while at >= 0:
        before = text[floor:at]
        start = floor + len(before.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1)
        floor = at + 1
        if domain and start < at:
            yield start, domain.end()
            floor = domain.end()
        at = text.find("@", floor)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the base kinds, by start and then kind as listed."""
    found = [(s, e, "email") for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((*m.span(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                found.append((*m.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], BASE_KINDS.index(s[2])))


def _score(text: str, start: int, end: int, kind: str) -> float:
    near = f"{text[max(0, start - REACH):start]} {text[end:end + REACH]}"
    score = _PRIOR[kind] + _CHECKSUM * (kind in ("card", "iban"))
    score += _CONTEXT * bool(_FOR[kind].search(near)) - _CONTEXT * bool(_AGAINST.search(near))
    return min(1.0, max(0.0, round(score, 6)))


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Accounts with a valid remainder; of one begin the longest end at a border that has it.

    A match may run into upper-case words behind the account, so it is cut back at its blanks.
    The search goes on at the account's end, or at the next word where there is none.
    """
    at = 0
    while m := _IBAN.search(text, at):
        start, end = m.span()
        at = m.start() + 4
        while end > start:
            account = text[start:end].replace(" ", "")
            if len(account) < IBAN_LEAST:
                break
            if mod97(account):
                yield start, end
                at = end
                break
            end = text.rfind(" ", start, end)


def _extra(text: str) -> Iterator[tuple[int, int, str]]:
    for start, end in _ibans(text):
        yield start, end, "iban"
    for m in _SSN.finditer(text):
        yield *m.span(), "ssn"
    for m in _NATIONAL.finditer(text):
        if 9 <= len(_digits(m[0])) <= 12:
            yield *m.span(), "phone_national"


def all_spans(text: str, min_score: float = MIN_SCORE) -> list[tuple[int, int, str, float]]:
    """Base spans and further spans with their scores, in order."""
    base = base_spans(text)
    out = [(s, e, kind, _score(text, s, e, kind)) for s, e, kind in base]
    # What is taken, as disjoint ranges in order: a span only has to look at its neighbour.
    starts: list[int] = []
    ends: list[int] = []
    for start, end, _ in base:
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    for start, end, kind in _extra(text):
        at = bisect_left(starts, end)  # ranges before this one begin before the span's end
        if at and ends[at - 1] > start:
            continue
        score = _score(text, start, end, kind)
        if score >= min_score:
            out.append((start, end, kind, score))
            starts.insert(at, start)
            ends.insert(at, end)
    order = BASE_KINDS + EXTRA_KINDS
    return sorted(out, key=lambda s: (s[0], order.index(s[2])))


_TABLE = np.zeros(256, dtype=bool)
_TABLE[[ord(c) for c in "@0123456789"]] = True


def _candidates(column: pa.Array) -> np.ndarray:
    """Which texts hold an at sign or a digit."""
    out = np.zeros(len(column), dtype=bool)
    for low, high, texts in slices(column):
        hits = np.flatnonzero(_TABLE[texts.data])
        out[low + np.unique(np.searchsorted(texts.offsets, hits, "right") - 1)] = True
    return out


_SPAN = "array<struct<start:int,end:int,kind:string,score:double>>"


def find_pii(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), min_score: float = MIN_SCORE) -> DataFrame:
    """``keep`` and ``pii``, the spans of every text with kind and score."""
    bound_batches(docs.sparkSession)
    source = docs.select(*keep, F.col("text").alias("__text"))
    fields = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)
    kind = pa.list_(
        pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64())])
    )

    def run(batches):
        for batch in batches:
            texts = batch.column("__text")
            rows: list[list[dict]] = [[] for _ in range(len(texts))]
            for i in np.flatnonzero(_candidates(texts)).tolist():
                rows[i] = [
                    {"start": s, "end": e, "kind": k, "score": score}
                    for s, e, k, score in all_spans(texts[i].as_py(), min_score)
                ]
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, kind)], [*keep, "pii"])

    return source.mapInArrow(run, f"{fields}, pii {_SPAN}")


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def _count_of(kind: str) -> Column:
    return F.size(F.filter("pii", lambda s: s["kind"] == kind))


def pii_digest(docs: DataFrame) -> DataFrame:
    """Counts per base kind, hash of the base spans and list of all spans, per document."""
    found = find_pii(docs)
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE_KINDS))
    counts = [_count_of(k).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(span_list(base), 256).alias("base_sha256"),
        span_list(F.col("pii")).alias("spans"),
        F.coalesce(F.array_max(F.transform("pii", lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )
