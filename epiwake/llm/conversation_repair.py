"""Repair of conversation structure by iterative-deepening A* over edits.

The roles of a sound conversation begin with ``s?(ua)+`` (initials), or it is empty. Each row is kept,
reroled or deleted, and empty rows may be inserted anywhere. The search goes depth first, in ASCII order
of the edits' initials, under a cost bound that rises to the least cost by which a branch exceeded it;
so the first accepting path is the cheapest and, among the cheapest, the least in ASCII. A state is (row,
role before it); a table holds for every failed state the least cost that its completion is known to
need, first from a bound by faults and neighbouring roles, then from the failures themselves.

Conversations of any length: rows are ordered by (conversation, turn) in range partitions and cut into
chunks of ``CHUNK`` rows. Nearly all conversations are one chunk and are solved where they lie. The
chunks of the others are searched in parallel, once for each role before and after them; a stream of
these few costs, backwards, gives every chunk the cost that remains after it; each chunk is then
searched for its own edits, and a stream forwards picks those of the role that really precedes it and
hashes the repaired rows, which SHA-256 only allows in order. Streams hold one chunk at a time.

Defined results: a null role or text is one space (in the damage key also a null id or turn); rows with a
null id are one conversation. Rows of one turn are ordered by role, the first 64 characters of the text
and a hash of it; equal rows are interchangeable. An empty role has no initial and cannot be kept. An
empty table gives no rows; extra columns are ignored. Gaps beyond 64 bits wrap around.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Steps, arrow_rows

#: Rows of a chunk.
CHUNK = 64
#: Characters of text in a chunk, beyond which it ends early.
CHUNK_CHARS = 1 << 20

# Cost of an edit, and of a truncated row that stays.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: States are the role before a row: none, system, user, assistant.
STATES = range(4)
START, SYSTEM, USER, ASSISTANT = STATES
_INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: The role that a new or reroled row takes after each state.
_NEXT = (USER, USER, ASSISTANT, USER)
_NAMES = {USER: "user", ASSISTANT: "assistant"}
#: (state, role) that may follow each other.
_LEGAL = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
_BLANKS = " \t\n\x0b\x0c\r"
#: Nothing remains to be paid after the last row if the conversation is empty or ends with the assistant.
AT_END = (0, math.inf, math.inf, 0)


class Row:
    """What the search needs of a row: its role by initial (0: any other), whether it must go, what it costs to stay."""

    __slots__ = ("kind", "must_go", "stay")

    def __init__(self, role: str, fault: str):
        self.kind = _INITIAL.get(role[:1], 0)
        self.must_go = fault in ("blank", "duplicate")
        self.stay = TRUNCATED if fault == "truncated" else 0


def _least(row: Row) -> int:
    """The least cost of a row on its own."""
    if row.must_go:
        return DELETE
    return min(DELETE, row.stay + (0 if row.kind else REROLE))


def lower_bounds(rows: list[Row], after: tuple, last: bool) -> list[float]:
    """Per state (4 * row + role before) a cost that every completion needs.

    Rows on their own, plus disjoint neighbours (rows that must go left out) that may not follow each
    other: those need an insertion or a change of one of them, or of a truncated one its deletion.
    """
    size = len(rows)
    floor = min(after)

    def extra(*held: Row) -> int:
        return DELETE - TRUNCATED if any(r.stay for r in held) else min(INSERT, REROLE)

    own = [_least(r) for r in rows]
    follow = [size] * (size + 1)
    for k in range(size - 1, -1, -1):
        follow[k] = follow[k + 1] if rows[k].must_go else k
    sums = [0] * (size + 1)
    for k in range(size - 1, -1, -1):
        sums[k] = sums[k + 1] + own[k]
    rest = [floor] * (size + 2)
    for k in range(size - 1, -1, -1):
        best = own[k] + rest[k + 1]
        j = follow[k + 1]
        if not rows[k].must_go and rows[k].kind:
            if j < size:
                if rows[j].kind and (rows[k].kind, rows[j].kind) not in _LEGAL:
                    best = max(best, sums[k] - sums[j + 1] + extra(rows[k], rows[j]) + rest[j + 1])
            elif last and rows[k].kind != ASSISTANT:
                best = max(best, sums[k] + extra(rows[k]))
        rest[k] = best
    table = []
    for k in range(size + 1):
        j = follow[k]
        for state in STATES:
            need = rest[k]
            if j < size and rows[j].kind and (state, rows[j].kind) not in _LEGAL:
                need = max(need, sums[k] - sums[j + 1] + extra(rows[j]) + rest[j + 1])
            table.append(need)
    if last:
        table[4 * size:] = [0, 2 * INSERT, INSERT, 0]
    else:
        table[4 * size:] = after
    return table


def search(rows: list[Row], state: int, after: tuple = AT_END, last: bool = True, need: list[float] | None = None) -> tuple[float, str, int]:
    """Cost (what follows included), edits and final role of the cheapest path, least in ASCII.

    ``after`` is what remains to be paid from each role after these rows; only after the ``last`` rows
    may more be inserted. Cost is infinite if no path exists. ``need`` is the table of failed states, which
    searches of the same rows and remaining costs may share.
    """
    size = len(rows)
    need = lower_bounds(rows, after, last) if need is None else need
    path: list[str] = []
    end = state

    def descend(k: int, role: int, budget: float) -> float:
        """-1 if a completion fits the budget; else the least cost that one is known to need."""
        nonlocal end
        at = 4 * k + role
        if need[at] > budget:
            return need[at]
        if k == size and after[role] <= budget:
            end = role
            return -1
        best = math.inf
        moves = []
        if k < size:
            row = rows[k]
            moves.append(("D", DELETE, k + 1, role))
            moves.append(("I", INSERT, k, _NEXT[role]))
            if not row.must_go:
                if (role, row.kind) in _LEGAL:
                    moves.append(("K", row.stay, k + 1, row.kind))
                else:
                    moves.append(("R", REROLE + row.stay, k + 1, _NEXT[role]))
        elif last:
            moves.append(("I", INSERT, k, _NEXT[role]))
        for edit, cost, to, then in moves:
            path.append(edit)
            found = descend(to, then, budget - cost)
            if found < 0:
                return -1
            path.pop()
            best = min(best, found + cost)
        need[at] = max(need[at], best)
        return need[at]

    # Deleting all rows and inserting two reaches whatever can be reached.
    most = DELETE * size + 3 * INSERT + max((x for x in after if x < math.inf), default=0)
    bound = need[state]
    while bound <= most:
        found = descend(0, state, bound)
        if found < 0:
            return bound, "".join(path), end
        bound = found
    return math.inf, "", state


def apply_edits(edits: str, state: int, roles: list[str], texts: list[str]) -> Iterator[tuple[str, str]]:
    """The repaired rows (role, text)."""
    k = 0
    for edit in edits:
        if edit == "I":
            state = _NEXT[state]
            yield _NAMES[state], ""
            continue
        if edit == "K":
            state = _INITIAL[roles[k][:1]]
            yield roles[k], texts[k]
        elif edit == "R":
            state = _NEXT[state]
            yield _NAMES[state], texts[k]
        k += 1


def own_fault(text: str) -> str:
    body = text.rstrip(_BLANKS)
    return "blank" if not body else "" if body[-1] in ".!?" else "truncated"


def digest(role: str, text: str) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(f"{len(role)}:{role}{text}".encode())


def faults_of(texts: list[str], digests: list[bytes], seen: set[bytes]) -> list[str]:
    """The first fault of each row; ``seen`` gets the digests."""
    faults = []
    for text, key in zip(texts, digests):
        fault = own_fault(text)
        faults.append("duplicate" if fault != "blank" and key in seen else fault)
        seen.add(key)
    return faults


class Tally:
    """The result row of one conversation, chunk by chunk."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.low = self.high = None
        self.distinct = 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        self.illegal, self.before = 0, None
        self.cost, self.audit, self.state = 0, [], START
        self.hash, self.any = hashlib.sha256(), False

    def add(self, turns: list, roles: list[str], texts: list[str], faults: list[str], edits: str) -> None:
        for turn, role, fault in zip(turns, roles, faults):
            if turn is not None and turn != self.high:
                self.low = turn if self.low is None else self.low
                self.high = turn
                self.distinct += 1
            self.faults[fault] += 1
            if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.before = role[:1]
        stays = iter(faults)
        for edit in edits:
            fault = next(stays) if edit != "I" else ""
            self.cost += {"D": DELETE, "I": INSERT, "R": REROLE, "K": 0}[edit]
            self.cost += TRUNCATED if edit in "KR" and fault == "truncated" else 0
        for role, text in apply_edits(edits, self.state, roles, texts):
            self.hash.update((("\n" if self.any else "") + f"{role}:{text}").encode())
            self.any = True
        self.audit.append(edits)

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        gaps = (gaps + (1 << 63)) % (1 << 64) - (1 << 63)
        return (self.conv_id, gaps, self.faults["blank"], self.faults["duplicate"], self.faults["truncated"], self.illegal,
                self.cost, "".join(self.audit), self.hash.hexdigest())


SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_CHUNK_SCHEMA = ("conv_id long, part long, chunk long, whole boolean, turns array<long>, roles array<string>, texts array<string>, "
                 "digests array<binary>")


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage; rows that are dropped stay with ``gone`` set, for their conversation's id."""
    spoken = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(spoken("conv_id"), F.lit(":"), spoken("turn"))), F.lit(20))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                spoken("role").alias("role"), spoken("text").alias("text"), kind.alias("kind"))
    gone = F.col("kind") == 0
    rows = rows.select(
        "conv_id", "turn", gone.alias("gone"),
        F.when(gone, "").when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("_copy"),
    )
    return rows.drop("_copy")


def _chunks(rows: DataFrame) -> DataFrame:
    """Ordered rows in chunks; ``whole`` marks those that surely hold their conversation alone."""
    keyed = rows.select("*", F.substring("text", 1, 64).alias("head"), F.xxhash64("text").alias("hash"),
                        F.monotonically_increasing_id().alias("salt"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "head", "hash", "salt"]
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(stream: Iterator[tuple]) -> Iterable[tuple]:
        part, number = TaskContext.get().partitionId(), 0
        first_conversation, started = True, False
        conv_id, pieces, turns, roles, texts, weight = None, 0, [], [], [], 0

        def chunk(whole: bool) -> tuple:
            return (conv_id, part, number, whole, turns, roles, texts, [digest(r, t) for r, t in zip(roles, texts)])

        for new_id, turn, gone, role, text in stream:
            if started and new_id != conv_id:
                # A conversation at either border of the partition may go on beyond it.
                yield chunk(not first_conversation and not pieces)
                number += 1
                first_conversation, pieces, turns, roles, texts, weight = False, 0, [], [], [], 0
            conv_id, started = new_id, True
            if len(turns) >= CHUNK or weight >= CHUNK_CHARS:
                yield chunk(False)
                number += 1
                pieces, turns, roles, texts, weight = pieces + 1, [], [], [], 0
            if not gone:
                turns, roles, texts = turns + [turn], roles + [role], texts + [text]
                weight += len(text)
        if started:
            yield chunk(False)

    return arrow_rows(ordered, ["conv_id", "turn", "gone", "role", "text"], run, _CHUNK_SCHEMA)


def _solve_whole(chunks: DataFrame) -> DataFrame:
    def run(stream: Iterator[tuple]) -> Iterable[tuple]:
        for conv_id, turns, roles, texts, digests in stream:
            faults = faults_of(texts, digests, set())
            tally = Tally(conv_id)
            tally.add(turns, roles, texts, faults, search([Row(r, f) for r, f in zip(roles, faults)], START)[1])
            yield tally.row()

    return arrow_rows(chunks.where("whole"), ["conv_id", "turns", "roles", "texts", "digests"], run, SCHEMA)


def _earlier_digests(parts: DataFrame) -> DataFrame:
    """(part, chunk, seen): the rows of a chunk that an earlier chunk of the conversation holds."""
    each = parts.select("conv_id", "part", "chunk", F.explode(F.array_distinct("digests")).alias("key"))
    first = each.groupBy("conv_id", "key").agg(F.min(F.struct("part", "chunk")).alias("first"))
    first = first.select(F.col("conv_id").alias("first_id"), F.col("key").alias("first_key"), "first")
    later = each.join(first, F.col("conv_id").eqNullSafe(F.col("first_id")) & (F.col("key") == F.col("first_key")))
    later = later.where(F.struct("part", "chunk") > F.col("first"))
    return later.groupBy("part", "chunk").agg(F.collect_set("key").alias("seen"))


def _costs(parts: DataFrame) -> DataFrame:
    """Faults of each chunk, its cost from each role before to each role after it, and to the end."""

    def run(stream: Iterator[tuple]) -> Iterable[tuple]:
        for conv_id, part, chunk, roles, texts, digests, seen in stream:
            faults = faults_of(texts, digests, set(seen or ()))
            rows = [Row(r, f) for r, f in zip(roles, faults)]
            one = [tuple(0 if s == to else math.inf for s in STATES) for to in STATES]
            failed = [lower_bounds(rows, after, False) for after in one]
            through = [float(search(rows, state, one[to], False, failed[to])[0]) for state in STATES for to in STATES]
            ending = lower_bounds(rows, AT_END, True)
            yield conv_id, part, chunk, faults, through, [float(search(rows, state, need=ending)[0]) for state in STATES]

    return arrow_rows(parts, ["conv_id", "part", "chunk", "roles", "texts", "digests", "seen"], run,
                      "conv_id long, part long, chunk long, faults array<string>, through array<double>, ending array<double>")


def _remaining(costs: DataFrame) -> DataFrame:
    """(part, chunk, last, after): what remains to be paid after each chunk, from each role."""
    order = [F.col("conv_id"), F.col("part").desc(), F.col("chunk").desc()]

    def run(stream: Iterator[tuple]) -> Iterable[tuple]:
        at, started, after = None, False, None
        for conv_id, part, chunk, through, ending in stream:
            last = not started or conv_id != at
            at, started = conv_id, True
            yield part, chunk, last, None if last else after
            after = ending if last else [min(through[4 * s + to] + after[to] for to in STATES) for s in STATES]

    ordered = costs.select("conv_id", "part", "chunk", "through", "ending").repartition("conv_id").sortWithinPartitions(*order)
    return arrow_rows(ordered, ["conv_id", "part", "chunk", "through", "ending"], run,
                      "part long, chunk long, last boolean, after array<double>")


def _with_edits(parts: DataFrame) -> DataFrame:
    """Each chunk with its edits and the role after it, for every role before it."""

    def run(stream: Iterator[tuple]) -> Iterable[tuple]:
        for conv_id, part, chunk, turns, roles, texts, faults, last, after in stream:
            rows = [Row(r, f) for r, f in zip(roles, faults)]
            after = AT_END if last else tuple(after)
            failed = lower_bounds(rows, after, last)
            found = [search(rows, s, after, last, failed) for s in STATES]
            yield conv_id, part, chunk, turns, roles, texts, faults, [f[1] for f in found], [f[2] for f in found]

    return arrow_rows(parts, ["conv_id", "part", "chunk", "turns", "roles", "texts", "faults", "last", "after"], run,
                      "conv_id long, part long, chunk long, turns array<long>, roles array<string>, texts array<string>, "
                      "faults array<string>, edits array<string>, ends array<long>")


def _chained(parts: DataFrame) -> DataFrame:
    """Result rows from the chunks of each conversation in order, one chunk in memory at a time."""

    def run(stream: Iterator[tuple]) -> Iterable[tuple]:
        tally = None
        for conv_id, turns, roles, texts, faults, edits, ends in stream:
            if tally is None or tally.conv_id != conv_id:
                if tally:
                    yield tally.row()
                tally = Tally(conv_id)
            tally.add(turns, roles, texts, faults, edits[tally.state])
            tally.state = ends[tally.state]
        if tally:
            yield tally.row()

    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk")
    return arrow_rows(ordered, ["conv_id", "turns", "roles", "texts", "faults", "edits", "ends"], run, SCHEMA)


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of (conv_id, turn, gone, role, text); see the module's docstring."""
    steps = Steps(rows.sparkSession, "conversation-repair")
    chunks = steps.save(_chunks(rows), "chunks")
    parts = chunks.where("not whole")
    known = parts.join(_earlier_digests(parts), ["part", "chunk"], "left")
    costs = steps.save(_costs(known), "costs")
    open_parts = parts.drop("digests", "whole").join(costs.select("part", "chunk", "faults"), ["part", "chunk"])
    open_parts = open_parts.join(_remaining(costs), ["part", "chunk"])
    return _solve_whole(chunks).unionByName(_chained(_with_edits(open_parts)))
