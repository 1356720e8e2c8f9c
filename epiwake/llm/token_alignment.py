"""Alignment of two tokenizers by diagonal run skipping, with corpus-wide counts of linked ids.

Both tokenizers cut the same bytes, so an alignment is the list of byte offsets where tokens of both
end. Between such offsets lies a group; two tokens whose ranges end together are linked. Where the
tokenizers agree, ends are equal along a diagonal: token ``i`` of A ends with token ``i + shift`` of B.
From a common end the packed end arrays are compared at the current shift in steps of 1, 2, 4, ...
tokens; after the first unequal step the step halves, so a run of ``n`` one-to-one tokens takes O(log n)
comparisons of memory. What follows is an irregular group: the side that is behind moves on until the
ends meet, and the difference of the indexes is the new shift.

Counting: each task aligns its documents in blocks and writes, for each block, the documents (with the
links as numbers of distinct id pairs) and those pairs with their counts. Pairs are summed over all
blocks by (A, B), the highest count of each B is a second aggregate, and each block gets the numbers of
its own pairs back. No task sees more than one block; the pair table is never broadcast.

Defined results: a text that is null, empty, or whose tokens do not give back a space and the text has
no tokens: zeros and an empty ``groups_sha256``. Repeated rows and rows with a null id each count and
each give a row. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Steps, arrow_rows
from .tokens import DEFAULT_VOCABULARY, Encoder, vocabulary_path

#: Piece vocabulary of the B side.
DEFAULT_PIECES = "piece_bpe_32k.model"
#: Links after which a block ends. A task holds them with their sort order, some 50 bytes each.
BLOCK_LINKS = 1_000_000

_DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long"


def matched_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of A and B tokens whose ranges end together, by diagonal run skipping.

    Both arrays rise strictly and end with the same offset.
    """
    size = len(ends_a)
    # Unequal ends after the last ones stop every probe, so no index has to be checked.
    list_a, list_b = ends_a.tolist() + [-1], ends_b.tolist() + [-2]
    bytes_a, bytes_b = array("q", list_a).tobytes(), array("q", list_b).tobytes()
    starts, shifts, lengths = [], [], []
    i = j = 0
    while i < size:
        a, b = list_a[i], list_b[j]
        # Irregular group: the side behind moves on until the ends meet.
        while a != b:
            if a < b:
                i += 1
                a = list_a[i]
            else:
                j += 1
                b = list_b[j]
        # One-to-one stretch at this shift: probe with doubling, then halving steps.
        first = i
        i += 1
        j += 1
        if list_a[i] == list_b[j]:
            i += 1
            j += 1
            step = 2
            while bytes_a[8 * i:8 * (i + step)] == bytes_b[8 * j:8 * (j + step)]:
                i += step
                j += step
                step *= 2
            while step > 1:
                step //= 2
                if bytes_a[8 * i:8 * (i + step)] == bytes_b[8 * j:8 * (j + step)]:
                    i += step
                    j += step
        starts.append(first)
        shifts.append(j - i)
        lengths.append(i - first)
    count = np.asarray(lengths, dtype=np.int64)
    if not count.size:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    in_a = np.repeat(np.asarray(starts, dtype=np.int64), count) + within
    return in_a, in_a + np.repeat(np.asarray(shifts, dtype=np.int64), count)


class GroupText:
    """The text form of groups, ``a1,a2|b1;a3|b2,b3``, from decimal ids made once."""

    def __init__(self, size_a: int, size_b: int):
        self.size = max(size_a, size_b)
        self.table = [f"{k}{mark}" for mark in (",", "|", ";") for k in range(self.size)]

    def of(self, ids_a: np.ndarray, ids_b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> str:
        sizes_a, sizes_b = np.diff(in_a, prepend=-1), np.diff(in_b, prepend=-1)
        marked_a, marked_b = ids_a.astype(np.int64), ids_b.astype(np.int64)
        marked_a[in_a] += self.size
        marked_b[in_b] += 2 * self.size
        before_b = np.cumsum(sizes_b) - sizes_b
        out = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
        out[np.arange(len(ids_a)) + np.repeat(before_b, sizes_a)] = marked_a
        out[np.arange(len(ids_b)) + np.repeat(np.cumsum(sizes_a), sizes_b)] = marked_b
        return "".join(map(self.table.__getitem__, out.tolist()))[:-1]


class Aligner:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, vocabulary: str = DEFAULT_VOCABULARY, pieces: str = DEFAULT_PIECES):
        import sentencepiece

        self.encoder = Encoder(vocabulary)
        self.bytes_a = self.encoder.token_bytes()
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(pieces))
        self.bytes_b = [self._piece_bytes(k) for k in range(self.pieces.get_piece_size())]
        self.length_a = np.array([len(x) for x in self.bytes_a], dtype=np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], dtype=np.int64)
        self.text = GroupText(len(self.bytes_a), len(self.bytes_b))

    def _piece_bytes(self, k: int) -> bytes:
        piece = self.pieces.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(k) else piece.replace("▁", " ").encode()

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of A and B, or None when one of them does not give the bytes back."""
        if not text:
            return None
        ids_a = np.frombuffer(self.encoder.ids(" " + text), dtype="<u4")
        list_b = self.pieces.encode(text, num_threads=1)
        plain = (" " + text).encode()
        # The rank form only cuts the bytes, so for A their number decides.
        if self.length_a[ids_a].sum() != len(plain) or b"".join(map(self.bytes_b.__getitem__, list_b)) != plain:
            return None
        return ids_a, np.array(list_b, dtype=np.int64)

    def align(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids of A, ids of B, and the indexes of linked tokens in both."""
        both = self.tokens(text)
        if both is None:
            return None
        ids_a, ids_b = both
        return ids_a, ids_b, *matched_ends(np.cumsum(self.length_a[ids_a]), np.cumsum(self.length_b[ids_b]))


class Block:
    """Aligned documents of one task, and the distinct pairs they link."""

    def __init__(self, number: int):
        self.number, self.documents, self.links, self.n_links = number, [], [], 0

    def add(self, head: tuple, links: np.ndarray) -> None:
        self.documents.append(head)
        self.links.append(links)
        self.n_links += links.size

    def rows(self) -> Iterator[tuple]:
        """Rows (block, documents as columns, pair numbers of all links, distinct pairs, their counts)."""
        links = np.concatenate(self.links) if self.links else np.empty(0, np.int64)
        pairs, numbers, counts = np.unique(links, return_inverse=True, return_counts=True)
        columns = [list(c) for c in zip(*self.documents)]
        yield (self.number, *columns, numbers.astype("<u4").tobytes(), (pairs >> 32).tolist(), (pairs & 0xFFFFFFFF).tolist(), counts.tolist())


def _aligned_blocks(docs: DataFrame, vocabulary: str, pieces: str, block_links: int) -> DataFrame:
    def run(stream: Iterator[tuple]) -> Iterable[tuple]:
        aligner = None
        part, number = TaskContext.get().partitionId() << 32, 0
        block = Block(part)
        for doc_id, text in stream:
            aligner = aligner or Aligner(vocabulary, pieces)
            aligned = aligner.align(text)
            if aligned is None:
                block.add((doc_id, 0, 0, 0, 0, ""), np.empty(0, np.int64))
            else:
                ids_a, ids_b, in_a, in_b = aligned
                digest = hashlib.sha256(aligner.text.of(*aligned).encode()).hexdigest()
                block.add((doc_id, ids_a.size, ids_b.size, in_a.size, in_a.size, digest),
                          ids_a[in_a].astype(np.int64) << 32 | ids_b[in_b])
            if block.n_links >= block_links or len(block.documents) >= 1 << 16:
                yield from block.rows()
                number += 1
                block = Block(part + number)
        if block.documents:
            yield from block.rows()

    return arrow_rows(docs, ["doc_id", "text"], run,
                      "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
                      "groups_sha256 array<string>, numbers binary, a array<long>, b array<long>, times array<long>")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(block, number, count, best) of each distinct pair of each block: its count in the whole corpus,
    and whether no other A id has a higher one with its B id."""
    pairs = blocks.select("block", F.posexplode(F.arrays_zip("a", "b", "times"))).select("block", F.col("pos").alias("number"), "col.*")
    summed = pairs.groupBy("a", "b").agg(F.sum("times").alias("count"))
    highest = summed.groupBy("b").agg(F.max("count").alias("highest"))
    judged = summed.join(highest, "b").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))
    return pairs.join(judged, ["a", "b"]).select("block", "number", "count", "best")


def align(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, pieces: str = DEFAULT_PIECES, block_links: int = BLOCK_LINKS) -> DataFrame:
    """One row per document of (doc_id, text); see the module's docstring."""
    steps = Steps(docs.sparkSession, "token-alignment")
    blocks = steps.save(_aligned_blocks(docs, vocabulary, pieces, block_links), "blocks", large_rows=True)
    judged = pair_counts(blocks.select("block", "a", "b", "times"))
    out = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
                     ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        places = right.column("number").to_numpy()
        counts, best = np.zeros(places.size, np.int64), np.zeros(places.size, np.int64)
        counts[places] = right.column("count").to_numpy()
        best[places] = right.column("best").to_numpy(zero_copy_only=False)
        for block in left.to_pylist():
            numbers = np.frombuffer(block["numbers"], dtype="<u4")
            ends = np.cumsum(block["n_links"])
            sums = [np.concatenate([[0], np.cumsum(x[numbers])]) for x in (best, counts)]
            n_best, count_sum = ((s[ends] - s[ends - np.asarray(block["n_links"])]).tolist() for s in sums)
            found.append(pa.table([block[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")] + [n_best, count_sum, block["groups_sha256"]],
                                  schema=out))
        return pa.concat_tables(found) if found else out.empty_table()

    # Read anew, so that the two sides of the cogroup do not share their columns.
    heads = docs.sparkSession.read.schema(blocks.schema).parquet(blocks._step_path).drop("a", "b", "times")
    return heads.groupBy("block").cogroup(judged.groupBy("block")).applyInArrow(finish, f"{_DOC}, n_best long, count_sum long, groups_sha256 string")
