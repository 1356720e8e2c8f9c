"""Conversation repair: the search against plain dynamic programming, the job against a plain loop."""

import hashlib
import random
import zlib
from functools import lru_cache

import pytest

from epiwake.llm import conversation_repair as repair
from epiwake.llm import queries


def cheapest(roles, faults):
    """(cost, audit) by dynamic programming over rows from the end."""
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(k, before, inserted):
        options = []
        if inserted < 3:
            c, t = best(k, follow[before], inserted + 1)
            options.append((c + 3, "I" + t))
        if k == len(roles):
            if before in ("", "a"):
                options.append((0, ""))
            return min(options, default=(10**9, ""))
        c, t = best(k + 1, before, 0)
        options.append((c + 4, "D" + t))
        if faults[k] not in ("blank", "duplicate"):
            stay = 3 if faults[k] == "truncated" else 0
            first = roles[k][:1]
            if first == follow[before] or (first == "s" and before == ""):
                c, t = best(k + 1, first, 0)
                options.append((c + stay, "K" + t))
            c, t = best(k + 1, follow[before], 0)
            options.append((c + 3 + stay, "R" + t))
        return min(options)

    for k in range(len(roles), 0, -10):
        for before in ("", "s", "u", "a"):
            best(k, before, 0)  # from the end, so that no call goes deep
    return best(0, "", 0)


def some_rows(rng, size):
    roles = [rng.choice(["user", "assistant", "system", "user", "assistant", "tool", " ", ""]) for _ in range(size)]
    faults = [rng.choice(["", "", "", "", "blank", "duplicate", "truncated"]) for _ in range(size)]
    return roles, faults


def test_search_equals_dynamic_programming():
    rng = random.Random(2)
    for _ in range(4000):
        roles, faults = some_rows(rng, rng.randint(0, 9))
        cost, audit, end = repair.search([repair.Row(r, f) for r, f in zip(roles, faults)], 0)
        assert (cost, audit) == cheapest(tuple(roles), tuple(faults)), (roles, faults)
    roles, faults = some_rows(rng, repair.CHUNK)
    assert repair.search([repair.Row(r, f) for r, f in zip(roles, faults)], 0)[:2] == cheapest(tuple(roles), tuple(faults))


def plain(data):
    """Result rows by loops, for rows (conv_id, turn, role, text)."""
    kept = {}
    for conv, turn, role, text in data:
        held = kept.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        role = "user" if kind == 4 else role
        held.extend([(turn, role, text)] * (2 if kind == 3 else 1))
    out = []
    for conv, rows in kept.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in rows:
            body = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[1][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = cheapest(tuple(r[1] for r in rows), tuple(faults))
        fixed, before, k = [], "", 0
        for e in audit:
            nxt = "assistant" if before == "u" else "user"
            if e == "I":
                fixed.append((nxt, ""))
            elif e != "D":
                fixed.append((nxt if e == "R" else rows[k][1], rows[k][2]))
            k += e != "I"
            before = fixed[-1][0][0] if fixed else ""
        text = "\n".join(f"{r}:{t}" for r, t in fixed)
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
                    hashlib.sha256(text.encode()).hexdigest()))
    return out


def sound(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("chunk", [2, 64])
def test_job_equals_plain_loops(spark, monkeypatch, chunk):
    """Small chunks send every conversation through the parallel search of chunks."""
    rng = random.Random(chunk)
    data = [(None, None, None, None), (None, 3, "user", "A?"), (0, None, "user", "x."), (0, None, None, "."), (0, 2**62, "a", "!"), (0, -2**62, "b", "é.")]
    for conv in range(1, 60):
        for turn in range(rng.choice([1, 2, 5, 9, 40])):
            data.append((conv, turn + rng.choice([0, 0, 0, 1, 7]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None]),
                         rng.choice(["Yes.", "No!", "cut", "Really? ", "", "  ", None, "line\none.", f"{rng.random()}.", "Yes."])))
    frame = spark.createDataFrame([(*d, "x") for d in data], "conv_id long, turn long, role string, text string, gone string").repartition(5)
    monkeypatch.setattr(repair, "CHUNK", chunk)
    assert sound(repair.repair(repair.damaged(frame)).collect()) == sound(plain(data))
    assert repair.repair(repair.damaged(frame.limit(0))).count() == 0


def test_one_conversation_over_many_partitions(spark):
    rng = random.Random(9)
    data = [(7, turn // 2, rng.choice(["user", "assistant"]), rng.choice(["Same.", f"Own {turn}.", "cut"])) for turn in range(1500)]
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert repair._chunks(repair.damaged(frame)).select("part").distinct().count() > 1
        assert sound(repair.repair(repair.damaged(frame)).collect()) == sound(plain(data))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_query_on_the_smoke_table(spark):
    folder = "/root/testdata/sf0.001"
    data = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()]
    assert sound(queries.op13_conversation_repair(spark, folder).collect()) == sound(plain(data))
