"""Personal data in text: patterns propose spans, checksums confirm them, context adjusts the score.

Base kinds are e-mail addresses, IPv4 addresses, payment cards (Luhn) and phone numbers with a plus;
their spans are fixed by pattern and check alone. The method adds IBANs (mod 97), national numbers
and phone numbers without a plus; these need a checksum or a word near them that speaks for them.

Defined results: a null text is empty and has no spans; each row is looked at on its own, so repeated
rows, null ids and other columns do no harm; an empty table gives no rows. Every pattern is matched in
time linear in the text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .common import arrow_rows

# Kinds in the order of the digest, then the added ones.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "national_id", "local_phone")
#: Characters before and after a span in which context words count.
CONTEXT = 60
#: Base score of a kind, what a word in the context adds, and the least score of an added span.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "national_id": 0.3, "local_phone": 0.3}
NEAR_BONUS, LEAST = 0.4, 0.6
# Words that speak for a kind.
NEAR_WORDS = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "national_id": ("ssn", "social security", "passport", "national id", "tax id"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
}
_NEAR = {kind: re.compile("|".join(rf"(?<!\w){re.escape(w)}" for w in words)) for kind, words in NEAR_WORDS.items()}

# Both quantifiers of a dotted run are possessive, so that a run is read once.
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])")
_NOT_LOCAL_PART = re.compile(r"[^A-Za-z0-9._%+-]")
_DIGIT = re.compile("[0-9]")
_NOT_DIGIT = re.compile("[^0-9]")


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float
    confirmed: bool


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether letters as numbers, first four characters last, leave 1 modulo 97."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, floor = text.find("@"), 0
    # Reversed once, so that the run left of each sign is found by one forward search.
    backward = text[::-1] if at >= 0 else ""
    size = len(text)
    while at >= 0:
        stop = _NOT_LOCAL_PART.search(backward, size - at, size - floor)
        start = size - stop.start() if stop else floor
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            floor = domain.end()
        at = text.find("@", max(at + 1, floor))


def _dotted(text: str) -> Iterator[tuple[int, int]]:
    for run in _DOTTED.finditer(text):
        parts = run.group().split(".")
        if len(parts) < 4:
            continue
        place = run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            end = place + sum(map(len, four)) + 3
            # Longer than three digits only with leading zeros, which change no value.
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:] or 0) <= 255 and int(p.lstrip("0")[:4] or 0) <= 255 for p in four):
                yield place, end
            place = end + 1


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        plain = m.group().replace(" ", "")
        if 15 <= len(plain) <= 34 and mod97(plain):
            yield m.span()


def spans_of(text: str | None) -> list[Span]:
    """All spans, ordered by kind as listed and then by start; offsets are code points, end exclusive."""
    text = text or ""
    digits = bool(_DIGIT.search(text))
    proposed: list[tuple[str, int, int, bool]] = []
    if "@" in text:
        proposed += [("email", a, b, False) for a, b in _emails(text)]
    if digits:
        proposed += [("ip", a, b, False) for a, b in _dotted(text)]
        proposed += [("card", a, b, True) for a, b in _cards(text)]
        if "+" in text:
            proposed += [("phone", a, b, False) for a, b in _phones(text)]
        base = _merged((a, b) for _, a, b, _ in proposed)
        added = [("iban", a, b, True) for a, b in _ibans(text)]
        added += [("national_id", *m.span(), False) for m in _NATIONAL.finditer(text)]
        added += [("local_phone", *m.span(), False) for m in _LOCAL.finditer(text)]
        proposed += [x for x in added if x[0] == "iban" or not _overlaps(base, x[1], x[2])]
    found = []
    for kind, a, b, confirmed in proposed:
        around = text[max(0, a - CONTEXT):a].lower() + "\n" + text[b:b + CONTEXT].lower()
        score = min(1.0, SCORES[kind] + (NEAR_BONUS if _NEAR[kind].search(around) else 0.0))
        if kind in BASE_KINDS or score >= LEAST:
            found.append(Span(kind, a, b, round(score, 2), confirmed))
    order = {kind: k for k, kind in enumerate(BASE_KINDS + ADDED_KINDS)}
    return sorted(found, key=lambda s: (order[s.kind], s.start, s.end))


def _merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans by start, overlapping ones joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _overlaps(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether one of the disjoint ordered spans meets [a, b)."""
    k = bisect_left(taken, (b,))
    return k > 0 and taken[k - 1][1] > a


def mask(text: str | None, spans: list[Span] | None = None) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    if text is None:
        return None
    spans = sorted(spans_of(text) if spans is None else spans, key=lambda s: (s.start, -s.end))
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at:s.start], f"[{s.kind.upper()}]"]
        at = max(at, s.end)
    return "".join(out) + text[at:] if out else text


def joined(spans: Iterable[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def find(docs: DataFrame) -> DataFrame:
    """Per document of (doc_id, text): counts of base kinds, their digest, all spans, and the spans
    with value, score and whether a checksum confirmed them."""

    def run(stream: Iterator[tuple]) -> Iterable[tuple]:
        for doc_id, text in stream:
            spans = spans_of(text)
            base = [s for s in spans if s.kind in BASE_KINDS]
            counts = [sum(s.kind == kind for s in base) for kind in BASE_KINDS]
            found = [(s.kind, s.start, s.end, text[s.start:s.end], s.score, s.confirmed) for s in spans]
            yield (doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans),
                   [dict(zip(("kind", "start", "end", "value", "score", "confirmed"), f)) for f in found])

    return arrow_rows(docs, ["doc_id", "text"], run,
                      "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
                      "found array<struct<kind:string,start:long,end:long,value:string,score:double,confirmed:boolean>>")


def masked(docs: DataFrame) -> DataFrame:
    """The documents with personal data in ``text`` replaced; every other column stays."""
    from pyspark.sql import functions as F
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def clean(text):  # noqa: ANN001, ANN202
        return text.map(mask, na_action="ignore")

    return docs.withColumn("text", clean(F.col("text")))
