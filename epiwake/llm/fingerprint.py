"""Document fingerprints: a homomorphic hash of the multiset of paragraphs.

Each paragraph (text between line feeds) gives a wide vector; the fingerprint is the sum of the
vectors of all paragraphs, lane by lane modulo a power of two. So it does not depend on the order of
paragraphs, and a paragraph is inserted or deleted by adding or subtracting its vector.

The vector has two parts. ``EQUAL_LANES`` lanes of 64 bits are uniform in the paragraph: two texts
have equal fingerprints if their multisets of paragraphs are equal, and else only by a collision of
all lanes. ``LIKE_LANES`` lanes of 32 bits are a random-sign sketch of the paragraph's word runs;
their sum is the sketch of the document, and the cosine of two sketches estimates how much of the
text is common, with a standard deviation of about ``1 / sqrt(LIKE_LANES)``.

Defined results: a null text is empty; the empty text is one empty paragraph. In ``edited_pairs``
"next" follows (doc_id with nulls first, text), the last is followed by the first, and a single
document by itself; repeated rows are documents of their own. Other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, WordHashes, arrow_rows, keyed, mixed, shingle_hashes

EQUAL_LANES, LIKE_LANES = 8, 128
#: Words of a run in the sketch.
RUN = 2
SIZE = 8 * EQUAL_LANES + 4 * LIKE_LANES

_LANE_KEYS = mixed(np.arange(1, EQUAL_LANES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Fingerprint:
    """Lanes of a multiset of paragraphs; adding and subtracting is exact modulo the lanes' powers."""

    __slots__ = ("equal", "like")

    def __init__(self, equal: np.ndarray | None = None, like: np.ndarray | None = None):
        self.equal = np.zeros(EQUAL_LANES, dtype=np.uint64) if equal is None else equal
        self.like = np.zeros(LIKE_LANES, dtype=np.uint32) if like is None else like

    def __add__(self, other: "Fingerprint") -> "Fingerprint":
        return Fingerprint(self.equal + other.equal, self.like + other.like)

    def __sub__(self, other: "Fingerprint") -> "Fingerprint":
        return Fingerprint(self.equal - other.equal, self.like - other.like)

    def hex(self) -> str:
        return (self.equal.astype("<u8").tobytes() + self.like.astype("<u4").tobytes()).hex()

    @classmethod
    def from_hex(cls, text: str) -> "Fingerprint":
        raw = bytes.fromhex(text)
        return cls(np.frombuffer(raw[:8 * EQUAL_LANES], "<u8").copy(), np.frombuffer(raw[8 * EQUAL_LANES:], "<u4").copy())

    def likeness(self, other: "Fingerprint") -> float:
        """1 for equal fingerprints, else the cosine of the sketches, at least 0."""
        if np.array_equal(self.equal, other.equal):
            return 1.0
        a, b = (x.view(np.int32).astype(np.float64) for x in (self.like, other.like))
        scale = float(np.sqrt(a @ a) * np.sqrt(b @ b))
        return min(1.0, max(0.0, float(a @ b) / scale)) if scale else 0.0


class Hasher:
    """Fingerprints of texts, with word hashes remembered."""

    def __init__(self) -> None:
        self.words = WordHashes()

    def paragraphs(self, paragraphs: list[str]) -> Fingerprint:
        """The sum of the vectors of these paragraphs."""
        import xxhash

        raw = [p.encode("utf-8", "surrogatepass") for p in paragraphs]
        if not raw:
            return Fingerprint()
        seeds = np.array([[xxhash.xxh3_64_intdigest(p), xxhash.xxh64_intdigest(p, 7)] for p in raw], dtype=np.uint64)
        lanes = mixed(seeds[:, :1] * np.uint64(2) + np.uint64(1) ^ _LANE_KEYS[None, :]) + seeds[:, 1:] * _LANE_KEYS[None, :]
        runs = [shingle_hashes(self.words.of(words), RUN) for p in raw if (words := p.translate(LOWER).split())]
        like = np.zeros(LIKE_LANES, dtype=np.int64)
        if runs:
            hashes = np.concatenate(runs)
            lane = (hashes & np.uint64(LIKE_LANES - 1)).astype(np.int64)
            up = (hashes >> np.uint64(63)).astype(np.int64)
            both = np.bincount(lane + LIKE_LANES * up, minlength=2 * LIKE_LANES)
            like = both[LIKE_LANES:] - both[:LIKE_LANES]
        return Fingerprint(lanes.sum(axis=0, dtype=np.uint64), like.astype(np.uint32))

    def text(self, text: str | None) -> Fingerprint:
        return self.paragraphs((text or "").split("\n"))

    def replaced_end(self, whole: Fingerprint, text: str, keep: int, end: str) -> Fingerprint:
        """The fingerprint of ``text[:keep] + end`` from that of ``text``: only paragraphs from the cut on are hashed."""
        start = text.rfind("\n", 0, keep) + 1
        gone = self.paragraphs(text[start:].split("\n"))
        new = self.paragraphs((text[start:keep] + end).split("\n"))
        return whole - gone + new


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) per document of (doc_id, text)."""

    def run(stream: Iterator[tuple]) -> Iterable[tuple]:
        hasher = Hasher()
        for doc_id, text in stream:
            yield doc_id, hasher.text(text).hex()

    return arrow_rows(docs, ["doc_id", "text"], run, "doc_id long, fingerprint string")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Each document with its edited text: the last quarter replaced by the start of the next document.

    Documents are dealt to ranges of keys, each text once; the first document of a range goes to the
    range before as well, so each range knows what follows its last document.
    """
    spark = docs.sparkSession
    plain = keyed(docs)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), plain.rdd.getNumPartitions())
    bounds = plain.approxQuantile("key", [k / ranges for k in range(1, ranges)], 0.25 / ranges) if ranges > 1 else []
    # One number per partition, not per document.
    cuts = sorted({int(b) for b in bounds})

    def range_of(key: int) -> int:
        return bisect.bisect_right(cuts, key)

    number = F.lit(0)
    if cuts:
        # Position of the key among the cuts, by a lookup that needs no Python.
        number = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("key"))) if len(cuts) <= 64 else _range_udf(cuts)("key")
    placed = plain.withColumn("part", number.cast("int"))
    firsts = sorted((r.part, r.key) for r in placed.groupBy("part").agg(F.min("key").alias("key")).collect())
    if not firsts:
        return spark.createDataFrame([], _EDITED)
    parts = [p for p, _ in firsts]
    # The first key of a range belongs to the range before it too; the very first to the last.
    ahead = {key: parts[k - 1] for k, (_, key) in enumerate(firsts)}
    lookup = spark.createDataFrame(list(ahead.items()), "first_key long, ahead int")
    extra = placed.join(F.broadcast(lookup), F.col("key") == F.col("first_key")).select("id", "key", "text", F.col("ahead").alias("part"), F.lit(1).alias("late"))
    dealt = (
        placed.select("id", "key", "text", "part", F.lit(0).alias("late")).unionAll(extra)
        .repartition(ranges, "part").sortWithinPartitions("part", "late", "key")
    )

    def run(stream: Iterator[tuple]) -> Iterable[tuple]:
        hasher = Hasher()
        before: tuple | None = None
        for doc_id, text, part, late in stream:
            own = hasher.text(text)
            if before is not None and before[2] == part:
                yield _edited(hasher, before, text, own)
            before = (doc_id, text, part, own) if not late else None

    return arrow_rows(dealt, ["id", "text", "part", "late"], run, _EDITED)


_EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _range_udf(cuts: list[int]):  # noqa: ANN202
    from pyspark.sql.functions import pandas_udf

    ordered = np.array(cuts, dtype=np.int64)

    @pandas_udf("int")
    def number(key):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(np.searchsorted(ordered, key.to_numpy(), side="right").astype(np.int32))

    return number


def _edited(hasher: Hasher, row: tuple, following: str, following_print: Fingerprint) -> tuple:
    doc_id, text, _, own = row
    taken = len(text) // 4
    keep = len(text) - taken
    end = following[:taken]
    edited = hasher.replaced_end(own, text, keep, end)
    digest = hashlib.sha256((text[:keep] + end).encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), digest, own.hex(), edited.hex(), own.likeness(edited), own.likeness(following_print)
