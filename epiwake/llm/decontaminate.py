"""Find benchmark passages in training text by spaced seeds, tolerant of replaced words.

A seed hashes the words at the ones of a fixed mask and ignores those at the zeros, so one replaced
word spoils few seeds. Seeds of the benchmark are joined with the seeds of every position of every
document; around each hit the words of document and item are compared on that diagonal, and all
segments in which matches outweigh replaced words count together.

The benchmark is taken in blocks of bounded size, each of which is sent to the tasks and meets all
documents in one pass without a shuffle, so a benchmark of any size is covered.

Defined results: a null or empty text, or an item without words, matches nothing. Items shorter
than every mask match by all their words. All texts under an item_id are searched and count as one
item; an item without id goes by the 64-bit hash of its text. Rows that repeat a doc_id share what is
found in any of them; a null doc_id is never reported as contaminated by ``flags`` but its row is
kept. Other columns are ignored; empty tables give no hits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_NO_PUNCTUATION, WordHashes, arrow_rows, mixed

# The masks. Ones are compared.
MASKS = ("1110111", "11011011", "110101011", "1011001101")
#: Matched words that make a document contaminated, or this share of a shorter item.
MIN_MATCHED, MIN_SHARE = 13, 0.8
#: A segment has at least this many matched words; a replaced word costs as much as so many matches.
MIN_SEGMENT, REPLACED_COST = 5, 2
#: Characters of benchmark text in a block, about.
BLOCK_CHARS = 4_000_000
FILTER_BITS = 23

_FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9),
            np.uint64(0x27D4EB2F165667C5), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))

HIT_SCHEMA = "doc_id long, item_id long, matched long, item_words long, replaced long, doc_word_start long, doc_word_end long"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(LOWER_NO_PUNCTUATION).split()


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """A hash per position of the words under the ones of the mask."""
    count = words.size - len(mask) + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.full(count, len(mask) * 0x51, dtype=np.uint64)
    for k, at in enumerate(i for i, bit in enumerate(mask) if bit == "1"):
        total += words[at:at + count] * _FACTORS[k % len(_FACTORS)]
        if k >= len(_FACTORS) - 1:
            total = mixed(total)
    return mixed(total)


class Block:
    """Some benchmark items with their seeds, sorted for lookup."""

    def __init__(self, items: list[tuple[int, str | None]]):
        cache = WordHashes()
        self.items = [(item_id, cache.of(words)) for item_id, text in items if (words := words_of(text))]
        self.masks = _masks_of(self.items)

    def __reduce__(self):
        # Sent without the lookup tables, which the other side makes again.
        return _block_again, (self.items,)

    def diagonals(self, words: np.ndarray) -> set[tuple[int, int]]:
        """(item, document position minus item position) of all hits."""
        found: set[tuple[int, int]] = set()
        for mask, hashes, item, place, table in self.masks:
            own = seeds(words, mask)
            at = np.flatnonzero(table[(own >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            if not at.size:
                continue
            low, high = np.searchsorted(hashes, own[at], "left"), np.searchsorted(hashes, own[at], "right")
            hit = high > low
            for p, a, b in zip(at[hit].tolist(), low[hit].tolist(), high[hit].tolist()):
                found.update((k, p - q) for k, q in zip(item[a:b].tolist(), place[a:b].tolist()))
        return found

    def hits(self, words: np.ndarray) -> Iterator[tuple]:
        """(item_id, matched, item words, replaced, first document word, last + 1) per item that is found."""
        by_item: dict[int, list[tuple]] = {}
        for k, shift in self.diagonals(words):
            if found := segments(words, self.items[k][1], shift):
                by_item.setdefault(k, []).extend(found)
        for k, parts in sorted(by_item.items()):
            item_id, item = self.items[k]
            least = min(MIN_MATCHED, int(np.ceil(item.size * MIN_SHARE)))
            covered = np.zeros(item.size, dtype=bool)
            replaced, first, last = 0, len(words), 0
            for matched, low, high, shift in parts:
                covered[low:high] |= matched
                replaced += int((~matched).sum())
                first, last = min(first, low + shift), max(last, high + shift)
            if covered.sum() >= least:
                yield item_id, int(covered.sum()), item.size, replaced, first, last


def _block_again(items: list[tuple]) -> "Block":
    block = Block([])
    block.items, block.masks = items, _masks_of(items)
    return block


def _masks_of(items: list[tuple]) -> list[tuple]:
    found: dict[str, list[tuple]] = {}
    for k, (_, words) in enumerate(items):
        for mask in [m for m in MASKS if len(m) <= words.size] or ["1" * words.size]:
            hashes = seeds(words, mask)
            found.setdefault(mask, []).append((hashes, np.full(hashes.size, k), np.arange(hashes.size)))
    masks = []
    for mask, parts in sorted(found.items()):
        hashes, item, place = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(hashes, kind="stable")
        table = np.zeros(1 << FILTER_BITS, dtype=bool)
        table[(hashes[order] >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        masks.append((mask, hashes[order], item[order], place[order], table))
    return masks


def segments(words: np.ndarray, item: np.ndarray, shift: int) -> list[tuple]:
    """All maximal runs on a diagonal that hold enough words: (matches, item start, item end, shift).

    A match counts 1, a replaced word ``-REPLACED_COST``. A run is maximal if all its beginnings and ends
    weigh more than nothing and no longer run has this property (Ruzzo and Tompa), so the runs are apart.
    """
    low, high = max(0, -shift), min(item.size, words.size - shift)
    same = item[low:high] == words[low + shift:high + shift]
    least = min(MIN_SEGMENT, item.size)
    if np.count_nonzero(same) < least:
        return []
    edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]])))
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -REPLACED_COST))])
    # (start, end, weight before, weight after, place of the last run before that begins with less weight)
    runs: list[tuple[int, int, int, int, int]] = []
    for start, end in edges.reshape(-1, 2).tolist():
        before, after = int(total[start]), int(total[end])
        at = len(runs) - 1
        while at >= 0:
            if runs[at][2] >= before:
                at = runs[at][4]
            elif runs[at][3] < after:
                # Joined to what stands between; the search goes on from the run it now begins with.
                start, _, before, _, back = runs[at]
                del runs[at:]
                at = back
            else:
                break
        runs.append((start, end, before, after, at))
    return [(same[a:b], low + a, low + b, shift) for a, b, *_ in runs if np.count_nonzero(same[a:b]) >= least]


def find(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each document of (doc_id, text) and item of (item_id, text) that it holds.

    Each text under an item_id is searched and gives a row of its own.
    """
    spark = docs.sparkSession
    # A missing id is replaced by a number of the text's own.
    items = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.xxhash64("text")).alias("item_id"), "text").where("text is not null").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // block_chars)
    found: DataFrame | None = None
    for number in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number)
        # About ``block_chars`` characters, so a bounded side.
        shared = spark.sparkContext.broadcast(Block([(r.item_id, r.text) for r in own.collect()]))
        part = _pass_over(docs, shared)
        found = part if found is None else found.unionAll(part)
    return found if found is not None else spark.createDataFrame([], HIT_SCHEMA)


def _pass_over(docs: DataFrame, shared) -> DataFrame:  # noqa: ANN001
    def run(stream: Iterator[tuple]) -> Iterable[tuple]:
        block, cache = shared.value, WordHashes()
        for doc_id, text in stream:
            words = cache.of(words_of(text))
            for hit in block.hits(words):
                yield doc_id, *hit

    return arrow_rows(docs, ["doc_id", "text"], run, HIT_SCHEMA)


def flags(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """(doc_id, contaminated, n_items, matched_words, replaced_words, items) per document."""
    per_item = hits.groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.max("replaced").alias("replaced"))
    # Items of one document are few: each takes several words of its text.
    per_doc = per_item.groupBy("doc_id").agg(
        F.count("*").alias("n_items"), F.sum("matched").alias("matched_words"), F.sum("replaced").alias("replaced_words"),
        F.concat_ws(",", F.sort_array(F.collect_list("item_id"))).alias("items"))
    zero = F.lit(0).cast("long")
    return docs.select("doc_id").join(per_doc, "doc_id", "left").select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("matched_words", zero).alias("matched_words"), F.coalesce("replaced_words", zero).alias("replaced_words"),
        F.coalesce("items", F.lit("")).alias("items"))
