"""Remove repeated passages: every byte covered by a string of ``LENGTH`` bytes seen earlier.

1. *Anchors.* In each window of ``LENGTH`` bytes the ``ANCHOR``-byte string of smallest hash is an
   anchor, so equal windows share an equal anchor at the same place. An anchor stands for its
   context, the windows around it, and is dealt by hash. Equal anchors with equal contexts need no
   further look: all but the first are repeats. They are combined in the map task first, so a
   passage in a third of all documents sends one row per task.
2. *Contested anchors* have several different contexts. Only their contexts are fetched, from the
   documents dealt by key. An anchor with very many contexts is split by the windows themselves.
3. *Interval expansion.* The contexts of a group form a text in which the anchor is one symbol.
   Its Burrows-Wheeler order is expanded breadth first: an interval of rows with a common prefix of
   length l is extended backward by a symbol to intervals of length l + 1, and two neighbouring rows
   that part at a level have their common prefix derived there. Expansion stops at the length of a
   window; rows that never parted are equal windows, and all but the first are repeats.
4. Repeats are dealt to their documents and cut out.

Defined results: a null text is empty; texts under ``LENGTH`` bytes are kept whole. "Earlier" is
the order of doc_id, then position; rows that repeat an id, or have none, are separate documents in
the order (id with nulls first, text). Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Steps, arrow_rows, bucket_count, bucket_of, keyed, pack_planes, split_by, unpack_planes

LENGTH, ANCHOR = 100, 50
#: Bytes of text after which a map task combines and passes on its anchors.
FLUSH_BYTES = 48 << 20
#: Contexts of one anchor above which it is split by window.
MANY_CONTEXTS = 1000
#: Symbols of one expansion; group, rank and row number of a symbol share 63 bits.
EXPANSION_SYMBOLS = 1 << 20
#: Long documents are hashed in pieces of so many window starts.
CHUNK = 1 << 20
MARK, END = 0xFF, 0xFE  # bytes that UTF-8 text never holds

_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    if not _powers:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            factors = np.full(CHUNK + 256, base, dtype=np.uint64)
            factors[0] = 1
            _powers[name] = np.multiply.accumulate(factors)
    return _powers["up"], _powers["down"]


def _slide(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over every ``width`` neighbouring values, by doubling."""
    step = 1
    while 2 * step <= width:
        values = pick(values[:-step], values[step:])
        step *= 2
    if step < width:
        values = pick(values[:values.size - (width - step)], values[width - step:])
    return values


def anchors(data: bytes, length: int = LENGTH, anchor: int = ANCHOR, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of all windows of ``data``."""
    up, down = _power_tables()
    windows = length - anchor + 1
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(data) - length + 1, chunk):
        part = np.frombuffer(data, np.uint8, min(chunk + length - 1, len(data) - at), at)
        prefix = np.zeros(part.size + 1, dtype=np.uint64)
        np.cumsum((part + np.uint64(1)) * up[:part.size], out=prefix[1:])
        hashes = (prefix[anchor:] - prefix[:-anchor]) * down[:part.size - anchor + 1]
        hashes ^= hashes >> np.uint64(29)
        hashes *= np.uint64(0xBF58476D1CE4E5B9)
        hashes ^= hashes >> np.uint64(32)
        least = _slide(hashes, windows, np.minimum)
        edge = np.zeros(windows - 1, dtype=np.uint64)
        # A position is an anchor if it is the minimum of some window around it.
        chosen = np.flatnonzero(hashes == _slide(np.concatenate([edge, least, edge]), windows, np.maximum))
        found.append((chosen + at, hashes[chosen]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    places, hashes = (np.concatenate(x) for x in zip(*found))
    if len(found) > 1:
        places, first = np.unique(places, return_index=True)
        hashes = hashes[first]
    return places, hashes


def _new_runs(*arrays: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before in any array."""
    new = np.ones(arrays[0].size, dtype=bool)
    if arrays[0].size:
        new[1:] = False
        for a in arrays:
            new[1:] |= a[1:] != a[:-1]
    return new


def _range_blocks(keys: np.ndarray, low: np.ndarray, high: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Window starts low..high of documents, packed by document bucket; adjoining ones are merged."""
    order = np.lexsort((low, keys))
    keys, low, high = keys[order], low[order], high[order]
    if keys.size:
        # The running maximum per document: starts are ordered, so a gap shows against what came before.
        new = np.ones(keys.size, dtype=bool)
        run = np.cumsum(_new_runs(keys)) * (1 << 40)
        reach = np.maximum.accumulate(high + run) - run
        new[1:] = (keys[1:] != keys[:-1]) | (low[1:] > reach[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], keys.size) - 1
        keys, low, high = keys[first], low[first], reach[last]
    for bucket, k, a, b in split_by(bucket_of(keys, buckets), keys, low, high):
        yield bucket, pickle.dumps((pack_planes(k), pack_planes(a), pack_planes(b - a)))


def _ranges_in(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, low, size = map(unpack_planes, pickle.loads(data))
    return keys, low, low + size


def _six_bytes(hashes: np.ndarray) -> bytes:
    """The low 48 bits. An anchor and its context are compared by 96 bits besides the bucket."""
    return hashes.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six_bytes(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view(np.uint64).ravel()


def _anchor_rows(docs: DataFrame, buckets: int) -> DataFrame:
    """Blocks of anchors by anchor bucket ('a') and of window ranges known to repeat ('r')."""

    def run(stream: Iterator[tuple]) -> Iterable[tuple]:
        import xxhash

        side = LENGTH - ANCHOR

        def flush(held: list[tuple]) -> Iterable[tuple]:
            hashes, contexts, keys, places, left, right = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((places, keys, contexts, hashes))
            hashes, contexts, keys, places, left, right = (x[order] for x in (hashes, contexts, keys, places, left, right))
            first = _new_runs(hashes, contexts)
            again = ~first
            for bucket, data in _range_blocks(keys[again], places[again] - left[again], places[again] - right[again], buckets):
                yield "r", bucket, data
            rows = (x[first] for x in (hashes, contexts, keys, places, left, right))
            hashes, *rest = rows
            for bucket, h, c, k, p, a, b in split_by(bucket_of(hashes.view(np.int64), buckets), hashes, *rest):
                yield "a", bucket, pickle.dumps((_six_bytes(h), _six_bytes(c), pack_planes(k), pack_planes(p), a.tobytes(), b.tobytes()))

        held, size = [], 0
        for key, text in stream:
            data = text.encode("utf-8", "surrogatepass")
            places, hashes = anchors(data)
            if places.size:
                contexts = np.fromiter(
                    (xxhash.xxh3_64_intdigest(data[max(0, p - side):p + LENGTH], min(p, side)) for p in places.tolist()),
                    dtype=np.uint64, count=places.size)
                left = np.minimum(places, side)
                right = places - np.minimum(places, len(data) - LENGTH)
                held.append((hashes, contexts, np.full(places.size, key, dtype=np.int64), places, left.astype(np.uint8), right.astype(np.uint8)))
                size += len(data)
            if size >= FLUSH_BYTES:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return arrow_rows(docs, ["key", "text"], run, "tag string, bucket long, data binary")


def _judged_anchors(dealt: DataFrame, buckets: int, many: int) -> DataFrame:
    """By document bucket: ranges that repeat ('0r') and contested anchors to look at ('1c')."""

    def run(stream: Iterator[tuple]) -> Iterable[tuple]:
        blocks = []
        for tag, bucket, data in stream:
            if tag == "r":
                yield "0r", bucket, data
            else:
                h, c, k, p, a, b = pickle.loads(data)
                blocks.append((_from_six_bytes(h), _from_six_bytes(c), unpack_planes(k), unpack_planes(p), np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)))
        if not blocks:
            return
        hashes, contexts, keys, places, left, right = (np.concatenate(x) for x in zip(*blocks))
        del blocks
        order = np.lexsort((places, keys, contexts, hashes))
        hashes, contexts, keys, places, left, right = (x[order] for x in (hashes, contexts, keys, places, left, right))
        first = _new_runs(hashes, contexts)
        again = ~first
        for bucket, data in _range_blocks(keys[again], places[again] - left[again], places[again] - right[again], buckets):
            yield "0r", bucket, data
        hashes, keys, places, left, right = (x[first] for x in (hashes, keys, places, left, right))
        group = np.cumsum(_new_runs(hashes)) - 1
        count = np.bincount(group)[group] if group.size else group
        several = count > 1
        crowded = count > many
        for bucket, h, k, p, a, b, m in split_by(bucket_of(keys[several], buckets), hashes[several], keys[several], places[several], left[several], right[several], crowded[several]):
            yield "1c", bucket, pickle.dumps((h.tobytes(), pack_planes(k), pack_planes(p), a.tobytes(), b.tobytes(), m.tobytes()))

    return arrow_rows(dealt, ["tag", "bucket", "data"], run, "tag string, bucket long, data binary")


def _group_blocks(records: list[tuple], buckets: int) -> Iterator[tuple[int, bytes]]:
    """Context records (group, key, first start, windows, symbols) packed by group bucket."""
    groups = np.array([r[0] for r in records], dtype=np.uint64)
    keys, starts = (np.array([r[k] for r in records], dtype=np.int64) for k in (1, 2))
    windows = np.array([r[3] for r in records], dtype=np.uint8)
    import zstandard

    packer = zstandard.ZstdCompressor(level=1)
    for bucket, rows in split_by(bucket_of(groups.view(np.int64), buckets), np.arange(len(records))):
        text = b"".join(records[r][4] + b"\xfe" for r in rows.tolist())
        yield bucket, pickle.dumps((groups[rows].tobytes(), pack_planes(keys[rows]), pack_planes(starts[rows]), windows[rows].tobytes(), packer.compress(text)))


def _fetched(dealt: DataFrame, buckets: int) -> DataFrame:
    """Documents meet their ranges and contested anchors.

    Out come finished documents ('done'), documents still to cut with the ranges known so far
    ('open'), contexts by group bucket ('group') and further ranges by document bucket ('range').
    """

    def run(stream: Iterator[tuple]) -> Iterable[tuple]:
        import xxhash
        import zstandard

        opened = zstandard.ZstdDecompressor()
        ranges, contested = [], []
        records: list[tuple] = []
        crowd: list[tuple] = []
        size = 0
        looked = False
        for tag, bucket, key, doc_id, data in stream:
            if tag == "0r":
                ranges.append(_ranges_in(data))
                continue
            if tag == "1c":
                h, k, p, a, b, m = pickle.loads(data)
                contested.append((np.frombuffer(h, np.uint64), unpack_planes(k), unpack_planes(p), np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8), np.frombuffer(m, bool)))
                continue
            if not looked:
                r_keys, r_low, r_high = _by_key(ranges, 0, 3)
                c_hash, c_keys, c_place, c_left, c_right, c_many = _by_key(contested, 1, 6)
                ranges = contested = None
                looked = True
            r0, r1 = np.searchsorted(r_keys, [key, key + 1])
            c0, c1 = np.searchsorted(c_keys, [key, key + 1])
            if r0 == r1 and c0 == c1:
                raw = opened.decompress(data)
                yield "done", bucket, key, doc_id, len(raw), hashlib.sha256(raw).hexdigest(), None, None
                continue
            yield "open", bucket, key, doc_id, None, None, data, pickle.dumps((pack_planes(r_low[r0:r1]), pack_planes(r_high[r0:r1])))
            if c0 < c1:
                raw = opened.decompress(data)
            for h, place, left, right, many in zip(c_hash[c0:c1].tolist(), c_place[c0:c1].tolist(), c_left[c0:c1].tolist(), c_right[c0:c1].tolist(), c_many[c0:c1].tolist()):
                symbols = raw[place - left:place] + b"\xff" + raw[place + ANCHOR:place - right + LENGTH]
                count = left - right + 1
                if not many:
                    records.append((h, key, place - left, count, symbols))
                    size += len(symbols)
                    continue
                for k in range(count):
                    window = symbols[k:k + LENGTH - ANCHOR + 1]
                    crowd.append((xxhash.xxh3_64_intdigest(window, h), key, place - left + k, 1, window))
                    size += len(window)
            if size >= FLUSH_BYTES // 4:
                yield from _passed_on(records, crowd, buckets)
                records, crowd, size = [], [], 0
        yield from _passed_on(records, crowd, buckets)

    return arrow_rows(dealt, ["tag", "bucket", "key", "id", "data"], run,
                      "kind string, bucket long, key long, doc_id long, n_bytes long, sha string, data binary, known binary")


def _by_key(blocks: list[tuple], key_at: int, width: int) -> list[np.ndarray]:
    if not blocks:
        return [np.empty(0, np.int64)] * width
    arrays = [np.concatenate(x) for x in zip(*blocks)]
    order = np.argsort(arrays[key_at], kind="stable")
    return [a[order] for a in arrays]


def _passed_on(records: list[tuple], crowd: list[tuple], buckets: int) -> Iterator[tuple]:
    if crowd:
        # Windows of a split anchor: only the task's first of each kind goes on.
        crowd.sort(key=lambda r: r[:3])
        first = [k == 0 or crowd[k][0] != crowd[k - 1][0] for k in range(len(crowd))]
        again = [(r[1], r[2]) for r, new in zip(crowd, first) if not new]
        records = records + [r for r, new in zip(crowd, first) if new]
        if again:
            keys, starts = (np.array(x, dtype=np.int64) for x in zip(*again))
            for bucket, data in _range_blocks(keys, starts, starts, buckets):
                yield "range", bucket, None, None, None, None, data, None
    if records:
        for bucket, data in _group_blocks(records, buckets):
            yield "group", bucket, None, None, None, None, data, None


def _ordered(key: np.ndarray, bits: int) -> np.ndarray:
    """Row numbers in the order of non-negative keys; number and key share 63 bits."""
    packed = (key << np.int64(bits)) | np.arange(key.size, dtype=np.int64)
    packed.sort()
    return packed & np.int64((1 << bits) - 1)


def common_windows(symbols: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, kin): suffixes in Burrows-Wheeler order within their groups, and for each row whether
    it shares its first ``length`` symbols and its group with the row before.

    Rows are sorted by at least ``length`` symbols; what follows them does not matter.
    """
    n = symbols.size
    bits = max(1, int(n).bit_length())
    after = np.append(symbols[1:], np.uint8(END)).astype(np.int64)
    key = (group.astype(np.int64) << 16) | (symbols.astype(np.int64) << 8) | after
    rows = _ordered(key, bits) if int(key.max()) >> (63 - bits) == 0 else np.argsort(key, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    rank[rows] = np.cumsum(_new_runs(key[rows])) - 1
    sorted_by = 2
    while sorted_by < length:
        follow = np.zeros(n, dtype=np.int64)
        follow[:-sorted_by] = rank[sorted_by:] + 1
        key = (rank << np.int64(bits)) | follow
        rows = _ordered(key, bits) if 3 * bits <= 63 else np.argsort(key, kind="stable")
        rank = np.empty(n, dtype=np.int64)
        rank[rows] = np.cumsum(_new_runs(key[rows])) - 1
        sorted_by *= 2
    rows = _ordered(rank, bits)
    row_of = np.empty(n + 1, dtype=np.int32)
    row_of[rows] = np.arange(n, dtype=np.int32)
    row_of[n] = 0
    # Row of the suffix one symbol on: the interval that is extended backward to this row.
    onward = row_of[rows + 1]
    parted = _new_runs(group[rows], symbols[rows])
    open_rows = np.flatnonzero(~parted)
    before, here = onward[open_rows - 1], onward[open_rows]
    level = 1
    while level < length and open_rows.size:
        interval = np.cumsum(parted, dtype=np.int32)
        together = interval[before] == interval[here]
        # Common prefix of these rows with the row before: ``level`` symbols.
        parted[open_rows[~together]] = True
        open_rows, before, here = open_rows[together], before[together], here[together]
        level += 1
    return rows, ~parted


def _expanded(dealt: DataFrame, buckets: int) -> DataFrame:
    """Ranges of repeated windows by document bucket, from the contexts of whole groups."""

    def run(stream: Iterator[tuple]) -> Iterable[tuple]:
        import zstandard

        opened = zstandard.ZstdDecompressor()
        groups, keys, starts, windows, texts = [], [], [], [], []
        for (data,) in stream:
            g, k, s, w, text = pickle.loads(data)
            groups.append(np.frombuffer(g, np.uint64))
            keys.append(unpack_planes(k))
            starts.append(unpack_planes(s))
            windows.append(np.frombuffer(w, np.uint8))
            texts.extend(opened.decompress(text).split(b"\xfe")[:-1])
        if not texts:
            return
        groups, keys, starts, windows = (np.concatenate(x) for x in (groups, keys, starts, windows))
        order = np.lexsort((starts, keys, groups))
        repeats: list[tuple] = []
        part: list[int] = []
        size = 0
        seen: dict[bytes, int] = {}
        current = None
        for r in order.tolist():
            if groups[r] != current:
                if size >= EXPANSION_SYMBOLS * 7 // 8:
                    repeats.extend(_repeated(part, groups, keys, starts, windows, texts))
                    part, size = [], 0
                current, seen = groups[r], {}
            if texts[r] in seen:
                # An equal context: its windows all repeat.
                repeats.append((keys[r:r + 1], starts[r:r + 1], starts[r:r + 1] + int(windows[r]) - 1))
                continue
            seen[texts[r]] = r
            part.append(r)
            size += len(texts[r]) + 1
        repeats.extend(_repeated(part, groups, keys, starts, windows, texts))
        if repeats:
            for bucket, data in _range_blocks(*(np.concatenate(x).astype(np.int64) for x in zip(*repeats)), buckets):
                yield bucket, data

    return arrow_rows(dealt, ["data"], run, "bucket long, data binary")


def _repeated(part: list[int], groups: np.ndarray, keys: np.ndarray, starts: np.ndarray, windows: np.ndarray, texts: list[bytes]) -> Iterator[tuple]:
    if len(part) < 2:
        return
    part_rows = np.array(part)
    sizes = np.array([len(texts[r]) + 1 for r in part], dtype=np.int64)
    symbols = np.frombuffer(b"".join(texts[r] + b"\xfe" for r in part), np.uint8)
    record = np.repeat(np.arange(len(part)), sizes)
    offset = np.arange(symbols.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    group = (np.cumsum(_new_runs(groups[part_rows])) - 1)[record]
    rows, kin = common_windows(symbols, group, LENGTH - ANCHOR + 1)
    run = np.cumsum(~kin)
    valid = offset[rows] < windows[part_rows][record[rows]]
    rows, run = rows[valid], run[valid]
    shared = np.bincount(run)[run] > 1 if run.size else run.astype(bool)
    rows, run = rows[shared], run[shared]
    source = part_rows[record[rows]]
    at, key = starts[source] + offset[rows], keys[source]
    order = np.lexsort((at, key, run))
    again = ~_new_runs(run[order])
    chosen = order[again]
    yield key[chosen], at[chosen], at[chosen]


def remove_repeats(docs: DataFrame, many: int = MANY_CONTEXTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) per document of (doc_id, text).

    ``kept`` holds the remaining bytes of documents that lost some, else null.
    """
    spark = docs.sparkSession
    steps = Steps(spark, "suffix-dedup")
    plain = keyed(docs)
    buckets = bucket_count(plain)
    judged = _judged_anchors(_anchor_rows(plain, buckets).repartition(buckets, "bucket"), buckets, many)

    def packed(stream: Iterator[tuple]) -> Iterable[tuple]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=1)
        for doc_id, key, text in stream:
            bucket = int(bucket_of(np.array([key], dtype=np.int64), buckets)[0])
            yield "2d", bucket, key, doc_id, packer.compress(text.encode("utf-8", "surrogatepass"))

    texts = arrow_rows(plain, ["id", "key", "text"], packed, "tag string, bucket long, key long, id long, data binary")
    none = F.lit(None).cast("long")
    dealt = texts.unionAll(judged.select("tag", "bucket", none.alias("key"), none.alias("id"), "data")).repartition(buckets, "bucket").sortWithinPartitions("tag")
    stored = steps.save(_fetched(dealt, buckets), "fetched", partition_by="kind")
    grouped = stored.where("kind = 'group'").select("bucket", "data").repartition(buckets, "bucket")
    ranges = _expanded(grouped, buckets).unionAll(stored.where("kind = 'range'").select("bucket", "data"))
    cut_rows = (
        stored.where("kind = 'open'").select(F.lit(1).alias("side"), "bucket", "key", "doc_id", "data", "known")
        .unionAll(ranges.select(F.lit(0).alias("side"), "bucket", none.alias("key"), none.alias("doc_id"), "data", F.lit(None).cast("binary").alias("known")))
        .repartition(buckets, "bucket").sortWithinPartitions("side")
    )
    done = stored.where("kind = 'done'").select(
        "doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"), F.lit(None).cast("binary").alias("kept"))
    return _cut(cut_rows).unionAll(done)


def cut_out(raw: bytes, low: np.ndarray, high: np.ndarray) -> tuple[bytes, int, int]:
    """What remains without the windows that start at low..high, the bytes removed and the runs."""
    change = np.zeros(len(raw) + 1, dtype=np.int32)
    np.add.at(change, low, 1)
    np.add.at(change, high + LENGTH, -1)
    gone = np.cumsum(change[:-1]) > 0
    runs = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0]) if gone.size else 0
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def _cut(dealt: DataFrame) -> DataFrame:
    def run(stream: Iterator[tuple]) -> Iterable[tuple]:
        import zstandard

        opened = zstandard.ZstdDecompressor()
        ranges, looked = [], False
        for side, key, doc_id, data, known in stream:
            if side == 0:
                ranges.append(_ranges_in(data))
                continue
            if not looked:
                keys, lows, highs = _by_key(ranges, 0, 3)
                ranges, looked = None, True
            a, b = np.searchsorted(keys, [key, key + 1])
            known_low, known_high = map(unpack_planes, pickle.loads(known))
            raw = opened.decompress(data)
            kept, removed, spans = cut_out(raw, np.concatenate([known_low, lows[a:b]]), np.concatenate([known_high, highs[a:b]]))
            yield doc_id, len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), kept if removed else None

    return arrow_rows(dealt, ["side", "key", "doc_id", "data", "known"], run,
                      "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
