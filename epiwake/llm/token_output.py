"""Packed token-id files: best-fit-decreasing packing with a segment tree over room.

Each input partition tokenizes its documents, packs them in blocks and writes a file per block: a
matrix of ids (rows of ``length``, padded), the cumulative segment lengths of the rows, and the
flat positions at which position ids start again at 0. A document longer than a row is cut into
full rows and a rest, so joining its pieces by ``start`` gives the ids back.

A file is written under a name of its own attempt. The returned rows name the files of the
attempts that counted, so files of lost attempts are never read.

Defined results: a null or empty text is one piece with only the end id; repeated rows are packed
each; a null id stays null; an empty table gives no rows and no files; other columns are ignored.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame

from epiwake.session import shared_dir

from .common import Steps, arrow_rows
from .tokens import DEFAULT_VOCABULARY, END_ID, Encoder

LENGTH = 2048
BLOCK_TOKENS = 2_000_000
SCHEMA = "doc_id long, start long, length long, doc_tokens long, block long, file string, row long, offset long, row_used long"


class Rooms:
    """Rows by remaining room; finds the smallest sufficient room in logarithmic time."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, room: int, row: int, by: int = 1) -> None:
        if by > 0:
            self.rows[room].append(row)
        node = room + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def take(self, room: int) -> tuple[int, int] | None:
        """(room, row) of the tightest row with at least ``room``, removed; None if there is none."""
        node = room + self.size
        if not self.count[node]:
            # Up until a right sibling holds rows, then down to its leftmost.
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        found = node - self.size
        row = self.rows[found].pop()
        self.add(found, row, -1)
        return found, row


def best_fit_decreasing(lengths: list[int], length: int) -> tuple[list[tuple], int]:
    """Pieces (document, start, tokens, row, offset) and the number of rows."""
    pieces, rests, rows = [], [], 0
    for k, n in enumerate(lengths):
        whole = n - n % length
        for start in range(0, whole, length):
            pieces.append((k, start, length, rows, 0))
            rows += 1
        if n > whole:
            rests.append((n - whole, k, whole))
    rests.sort(key=lambda r: (-r[0], r[1]))
    rooms = Rooms(length)
    for tokens, k, start in rests:
        found = rooms.take(tokens)
        if found is None:
            room, row = length, rows
            rows += 1
        else:
            room, row = found
        pieces.append((k, start, tokens, row, length - room))
        if room > tokens:
            rooms.add(room - tokens, row)
    return pieces, rows


def file_bytes(matrix: np.ndarray, row_starts: np.ndarray, cumulative: np.ndarray, resets: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, ids=matrix, row_segments=row_starts, cumulative_lengths=cumulative, position_resets=resets)
    return out.getvalue()


def read_file(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as held:
        return {name: held[name] for name in held.files}


def position_ids(resets: np.ndarray, size: int) -> np.ndarray:
    """Position of every slot since the last reset."""
    at = np.zeros(size, dtype=np.int64)
    at[resets] = resets
    return np.arange(size) - np.maximum.accumulate(at)


def write_packed(docs: DataFrame, folder: str | None = None, length: int = LENGTH, vocabulary: str = DEFAULT_VOCABULARY,
                 end_id: int = END_ID, pad_id: int = END_ID, id_type: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Write the files and return the stored manifest: one row per piece of every document."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/packed-{uuid.uuid4().hex}"

    def run(stream: Iterator[tuple]) -> Iterable[tuple]:
        from pyarrow import fs

        encoder, end = Encoder(vocabulary), int(end_id).to_bytes(4, "little")
        context = TaskContext.get()
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)

        def block(held: list[tuple], number: int) -> Iterable[tuple]:
            pieces, rows = best_fit_decreasing([len(ids) // 4 for _, ids in held], length)
            pieces.sort(key=lambda p: (p[3], p[4]))
            matrix = np.full((rows, length), pad_id, dtype=id_type)
            flat, used = matrix.reshape(-1), np.zeros(rows, dtype=np.int64)
            lengths = np.array([p[2] for p in pieces], dtype=np.int32)
            for k, start, tokens, row, offset in pieces:
                ids = np.frombuffer(held[k][1], "<u4")[start:start + tokens]
                if ids.size and int(ids.max()) > np.iinfo(id_type).max:
                    raise ValueError(f"id {ids.max()} does not fit {id_type}; pass a wider id_type")
                flat[row * length + offset:row * length + offset + tokens] = ids
                used[row] += tokens
            row_of = np.array([p[3] for p in pieces], dtype=np.int64)
            starts = np.searchsorted(row_of, np.arange(rows + 1))
            resets = np.array([p[3] * length + p[4] for p in pieces], dtype=np.int64)
            name = f"block-{context.partitionId():06d}-{number:05d}-{context.taskAttemptId()}.npz"
            with store.open_output_stream(f"{path}/{name}", compression=None) as out:
                out.write(file_bytes(matrix, starts, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), resets))
            for k, start, tokens, row, offset in pieces:
                doc_id, ids = held[k]
                yield doc_id, start, tokens, len(ids) // 4, (context.partitionId() << 32) + number, name, row, offset, int(used[row])

        held, tokens, number = [], 0, 0
        for doc_id, text in stream:
            ids = encoder.ids(text or "") + end
            held.append((doc_id, ids))
            tokens += len(ids) // 4
            if tokens >= block_tokens:
                yield from block(held, number)
                held, tokens, number = [], 0, number + 1
        if held:
            yield from block(held, number)

    manifest = Steps(spark, "packed-manifest").save(arrow_rows(docs, ["doc_id", "text"], run, SCHEMA), "manifest")
    manifest._packed_folder = folder
    return manifest
