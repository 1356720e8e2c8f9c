"""Secrets in text: strong parts by pattern alone, weak parts only where complementary parts meet.

A credential usually has several parts: an identifier (who), a secret (the proof) and an endpoint
(where). Base spans (assignments, access ids, long hexadecimal runs) are strong parts and always
reported. Weak parts (user names, unlabelled high-entropy strings, short passwords, addresses) are
far too common to report alone. They are joined by interval: two parts meet when they lie in one scope
(a block of text without a blank line) and their starts are at most ``REACH`` code points apart.

* A weak secret counts when a strong identifier meets it, or when both an identifier and an endpoint do.
* A weak identifier or endpoint counts when a secret that counts meets it.
* Every secret that counts is linked with its nearest identifier and nearest endpoint, the earlier one
  on a tie.

All joins are binary searches in the sorted starts of a role, so time grows with the parts and not with
their pairs. One pass over the documents, nothing is shuffled.

Defined results: a null text is empty and has no spans; each row is looked at on its own, so repeated
rows, null ids and other columns do no harm; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .common import arrow_rows

# Kinds in the order of the digest, then the weak ones.
BASE_KINDS = ("assign", "access", "hex")
WEAK_KINDS = ("weak_secret", "identifier", "endpoint")
ORDER = {kind: k for k, kind in enumerate(BASE_KINDS + WEAK_KINDS)}
ROLES = {"assign": "secret", "hex": "secret", "weak_secret": "secret", "access": "identifier", "identifier": "identifier",
         "endpoint": "endpoint"}
#: Most code points between the starts of two parts that belong together.
REACH = 300
#: Least bits a character of an unlabelled secret.
LEAST_ENTROPY = 4.0

_FLAGS = re.ASCII | re.IGNORECASE
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _FLAGS)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

# A key may be part of a longer name ("db_user"), its value ends at a quote, separator or white space.
_VALUE = r"""["']?[ \t]{0,8}[:=][ \t]{0,8}["']?([^\s"',;]{%d,200})"""
_IDENTIFIER = re.compile(r"(?:client_?id|app_?id|user_?name|user|login|account|key_?id)" + _VALUE % 2, _FLAGS)
_HOST = re.compile(r"(?:end_?point|host_?name|host|server|base_?url|url|region)" + _VALUE % 3, _FLAGS)
_ADDRESS = re.compile(r"""[A-Za-z][A-Za-z0-9+]{1,15}://[^\s"'<>]{3,500}""")
_USER_INFO = re.compile(r"://([^\s/:@]{1,100}):([^\s/@]{1,100})@")
_WEAK_ASSIGN = re.compile(r"(?:pwd|pass|passphrase|private_?key|signature|credential)" + _VALUE % 4, _FLAGS)
_BLOB = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{32,88}={0,2}(?![A-Za-z0-9+/=_-])")
_BLANK_LINE = re.compile(r"\n[ \t\r]*\n")


@dataclass(frozen=True)
class Part:
    kind: str
    start: int
    end: int

    @property
    def role(self) -> str:
        return ROLES[self.kind]


def base_parts(text: str) -> list[Part]:
    """The strong parts, by start and then kind."""
    found = []
    lowered = text.lower()
    if any(word in lowered for word in _ASSIGN_WORDS):
        found += [Part("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [Part("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [Part("hex", *m.span()) for m in _HEX.finditer(text)]
    return _sorted(found)


def _sorted(parts: Iterable[Part]) -> list[Part]:
    return sorted(parts, key=lambda p: (p.start, ORDER[p.kind], p.end))


def entropy(value: str) -> float:
    counts = Counter(value).values()
    return -sum(n / len(value) * math.log2(n / len(value)) for n in counts)


def _random_looking(value: str) -> bool:
    classes = any(c.isdigit() for c in value) + any(c.isupper() for c in value) + any(c.islower() for c in value)
    return classes == 3 and entropy(value) >= LEAST_ENTROPY


def weak_parts(text: str, base: list[Part]) -> list[Part]:
    """Candidates that need support; those that overlap a strong part or an earlier candidate go."""
    found = []
    if "=" in text or ":" in text:
        found += [Part("weak_secret", *m.span(1)) for m in _WEAK_ASSIGN.finditer(text)]
        found += [Part("identifier", *m.span(1)) for m in _IDENTIFIER.finditer(text)]
    for m in _BLOB.finditer(text):
        if _random_looking(m.group()):
            found.append(Part("weak_secret", *m.span()))
    inner = []
    if "://" in text:
        for m in _USER_INFO.finditer(text):
            inner += [Part("identifier", *m.span(1)), Part("weak_secret", *m.span(2))]
        found += inner
    taken = _free(_sorted(found), base)
    # An address may hold parts, so it only gives way to other endpoints.
    places = [Part("endpoint", *m.span()) for m in _ADDRESS.finditer(text)] if "://" in text else []
    if "=" in text or ":" in text:
        places += [Part("endpoint", *m.span(1)) for m in _HOST.finditer(text)]
    return taken + _free(_sorted(places), [])


def _free(parts: list[Part], taken: list[Part]) -> list[Part]:
    """Of parts by start those that overlap neither ``taken`` nor a part kept before."""
    out, at, k, blocked = [], 0, 0, 0
    for p in parts:
        while k < len(taken) and taken[k].start < p.end:
            blocked = max(blocked, taken[k].end)
            k += 1
        if p.start >= at and p.start >= blocked:
            out.append(p)
            at = p.end
    return out


class Scopes:
    """The blocks of a text between blank lines, and the parts of each role in reach of a place."""

    def __init__(self, text: str, parts: Iterable[Part]):
        self.borders = [m.end() for m in _BLANK_LINE.finditer(text)]
        self.by_role: dict[str, list[Part]] = {"secret": [], "identifier": [], "endpoint": []}
        for p in _sorted(parts):
            self.by_role[p.role].append(p)
        self.starts = {role: [p.start for p in held] for role, held in self.by_role.items()}

    def reach(self, p: Part) -> tuple[int, int]:
        """The interval of starts that meet ``p``, cut at the borders of its scope."""
        k = bisect_right(self.borders, p.start)
        low = self.borders[k - 1] if k else 0
        high = self.borders[k] - 1 if k < len(self.borders) else p.start + REACH
        return max(low, p.start - REACH), min(high, p.start + REACH)

    def nearest(self, p: Part, role: str) -> Part | None:
        low, high = self.reach(p)
        starts, held = self.starts[role], self.by_role[role]
        k = bisect_left(starts, p.start)
        beside = [held[j] for j in (k - 1, k) if 0 <= j < len(held) and low <= starts[j] <= high]
        return min(beside, key=lambda x: (abs(x.start - p.start), x.start), default=None)


def parts_of(text: str | None) -> tuple[list[Part], list[tuple[Part, Part | None, Part | None]]]:
    """All reported parts by start and kind, and (secret, identifier, endpoint) of each linked secret."""
    text = text or ""
    base = base_parts(text)
    weak = weak_parts(text, base)
    if not weak:
        # Strong parts may still meet each other.
        scopes = Scopes(text, base)
        return base, _links(scopes, [p for p in base if p.role == "secret"])
    scopes = Scopes(text, base + weak)
    strong_ids = Scopes(text, [p for p in base if p.role == "identifier"])
    strong_ids.borders = scopes.borders
    counted = []
    for p in scopes.by_role["secret"]:
        if p.kind in BASE_KINDS or strong_ids.nearest(p, "identifier") or (scopes.nearest(p, "identifier") and scopes.nearest(p, "endpoint")):
            counted.append(p)
    support = Scopes(text, counted)
    support.borders = scopes.borders
    reported = base + [p for p in counted if p.kind not in BASE_KINDS]
    reported += [p for p in weak if p.role != "secret" and support.nearest(p, "secret")]
    return _sorted(reported), _links(scopes, counted)


def _links(scopes: Scopes, secrets: list[Part]) -> list[tuple[Part, Part | None, Part | None]]:
    linked = [(s, scopes.nearest(s, "identifier"), scopes.nearest(s, "endpoint")) for s in secrets]
    return [x for x in linked if x[1] or x[2]]


def joined(parts: Iterable[Part]) -> str:
    return ",".join(f"{p.kind}:{p.start}:{p.end}" for p in parts)


def find(docs: DataFrame) -> DataFrame:
    """Per document of (doc_id, text): counts of the base kinds, their digest, all spans, the spans with
    role and value, and the linked credentials (values of secret, identifier and endpoint)."""

    def run(stream: Iterator[tuple]) -> Iterable[tuple]:
        for doc_id, text in stream:
            parts, links = parts_of(text)
            base = [p for p in parts if p.kind in BASE_KINDS]
            counts = [sum(p.kind == kind for p in base) for kind in BASE_KINDS]
            found = [{"kind": p.kind, "role": p.role, "start": p.start, "end": p.end, "value": text[p.start:p.end],
                      "strong": p.kind in BASE_KINDS} for p in parts]
            credentials = [{name: text[p.start:p.end] if p else None for name, p in zip(("secret", "identifier", "endpoint"), link)}
                           for link in links]
            yield (doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(parts), found, credentials)

    return arrow_rows(docs, ["doc_id", "text"], run,
                      "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
                      "found array<struct<kind:string,role:string,start:long,end:long,value:string,strong:boolean>>, "
                      "credentials array<struct<secret:string,identifier:string,endpoint:string>>")
