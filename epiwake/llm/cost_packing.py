"""Cost-balanced packing of token ids into sequences of bounded length.

A piece of ``n`` tokens costs ``linear * n + quadratic * n * n`` (attention inside a segment). A
document is cut into full pieces and a rest. Of each block of documents, descending pieces go to
the sequence of lowest cost that has room; as many sequences are opened as the block's tokens fill,
so when a piece fits nowhere it is cut at the room of the cheapest sequence with any. Less than one
sequence per block is padding, and nothing is shuffled: a block is a run of one input partition.

Defined results: a null or empty text is one piece with only the end id. Repeated rows are packed
each. A null id stays null. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import arrow_rows
from .tokens import DEFAULT_VOCABULARY, END_ID, Encoder

#: Tokens of a block; its ids are held in memory (4 bytes each).
BLOCK_TOKENS = 2_000_000
LINEAR, QUADRATIC = 1.0, 1.0 / 512

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "sequence_cost double")


class Sequences:
    """Open sequences by remaining room; finds the cheapest with enough room in logarithmic time."""

    def __init__(self, count: int, length: int):
        import heapq

        self.heapq, self.length = heapq, length
        self.size = 1 << length.bit_length()
        self.by_room = [[] for _ in range(self.size)]
        self.by_room[length] = [(0.0, k) for k in range(count)]
        self.used = [0] * count
        self.cost = [0.0] * count
        self.best: list[tuple] = [(float("inf"), -1)] * (2 * self.size)
        self._refresh(length)

    def _refresh(self, room: int) -> None:
        held = self.by_room[room]
        node = room + self.size
        self.best[node] = held[0] if held and room else (float("inf"), -1)
        node >>= 1
        while node:
            self.best[node] = min(self.best[2 * node], self.best[2 * node + 1])
            node >>= 1

    def cheapest(self, room: int) -> int:
        """The cheapest sequence with at least ``room``, or -1."""
        best, low, high = (float("inf"), -1), room + self.size, 2 * self.size
        while low < high:
            if low & 1:
                best = min(best, self.best[low])
                low += 1
            if high & 1:
                high -= 1
                best = min(best, self.best[high])
            low >>= 1
            high >>= 1
        return best[1]

    def place(self, sequence: int, tokens: int, cost: float) -> int:
        """Add tokens to a sequence that is the cheapest of its room; returns their offset."""
        room = self.length - self.used[sequence]
        self.heapq.heappop(self.by_room[room])
        self._refresh(room)
        offset = self.used[sequence]
        self.used[sequence] += tokens
        self.cost[sequence] += cost
        room -= tokens
        self.heapq.heappush(self.by_room[room], (self.cost[sequence], sequence))
        self._refresh(room)
        return offset


def pack_lengths(lengths: list[int], length: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[list[tuple], list[float]]:
    """Pieces (document, start, tokens, sequence, offset) and the cost of each sequence."""
    pieces, full = [], []
    rests = []
    for k, n in enumerate(lengths):
        whole = n - n % length
        full.extend((k, start) for start in range(0, whole, length))
        if n > whole:
            rests.append((n - whole, k, whole))
    rests.sort(key=lambda r: (-r[0], r[1]))
    open_count = -(-sum(r[0] for r in rests) // length)
    packed = Sequences(open_count, length)
    for tokens, k, start in rests:
        while tokens:
            to = packed.cheapest(tokens)
            put = tokens
            if to < 0:
                to = packed.cheapest(1)
                put = length - packed.used[to]
            offset = packed.place(to, put, linear * put + quadratic * put * put)
            pieces.append((k, start, put, to, offset))
            start, tokens = start + put, tokens - put
    pieces.extend((k, start, length, open_count + j, 0) for j, (k, start) in enumerate(full))
    return pieces, packed.cost + [linear * length + quadratic * length * length] * len(full)


def pack(docs: DataFrame, length: int = 1024, vocabulary: str = DEFAULT_VOCABULARY, end_id: int = END_ID,
         linear: float = LINEAR, quadratic: float = QUADRATIC, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece of every document of (doc_id, text).

    ``sequence_id`` holds the input partition above 32 bits and a number in it below, so it is
    unique without a shuffle and the same when a task runs again.
    """

    def run(stream: Iterator[tuple]) -> Iterable[tuple]:
        encoder = Encoder(vocabulary)
        end = int(end_id).to_bytes(4, "little")
        base = TaskContext.get().partitionId() << 32

        def block(held: list[tuple], first: int) -> tuple[list[tuple], int]:
            pieces, costs = pack_lengths([len(ids) // 4 for _, ids in held], length, linear, quadratic)
            rows = []
            for k, start, tokens, sequence, offset in pieces:
                doc_id, ids = held[k]
                crc = zlib.crc32(memoryview(ids)[4 * start:4 * (start + tokens)])
                rows.append((doc_id, start, tokens, crc, len(ids) // 4, base + first + sequence, offset, costs[sequence]))
            return rows, first + len(costs)

        held, tokens, first = [], 0, 0
        for doc_id, text in stream:
            ids = encoder.ids(text or "") + end
            held.append((doc_id, ids))
            tokens += len(ids) // 4
            if tokens >= block_tokens:
                rows, first = block(held, first)
                yield from rows
                held, tokens = [], 0
        if held:
            yield from block(held, first)[0]

    return arrow_rows(docs, ["doc_id", "text"], run, SCHEMA)
