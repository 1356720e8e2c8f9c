"""Operators over the whole corpus: near copies, archives, fingerprints, packing, repeats, pipeline."""

import hashlib
import io
import itertools
import random

import numpy as np
import pyarrow.fs
import pytest

from epiwake.llm import common, cost_packing, fingerprint, near_dup, suffix_dedup, token_output, warc
from epiwake.llm.common import Steps
from epiwake.llm.components import connected_components
from epiwake.llm.tokens import Encoder

ODD = [(1, ""), (2, None), (3, "word " * 30_000), (None, "plain text"), (1, ""), (4, "\x1c\n\t é 🙂"), (5, None)]


def odd_docs(spark):
    """Nulls, repeated rows, empty and long texts, and an extra column with a clashing name."""
    return spark.createDataFrame([(i, t, "x", 5) for i, t in ODD], "doc_id long, text string, key string, bucket int")


def words(rng, n):
    return [f"w{rng.randint(0, 4000)}" for _ in range(n)]


def shingles(text, width):
    w = (text or "").encode().translate(near_dup.LOWER).split()
    return frozenset(tuple(w[k:k + width]) for k in range(len(w) - width + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def smallest_linked(sets, percent):
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in itertools.combinations(sorted(sets), 2):
        both = len(sets[u] & sets[v])
        if both and 100 * both >= percent * len(sets[u] | sets[v]):
            a, b = top(u), top(v)
            root[max(a, b)] = min(a, b)
    return {i: top(i) for i in sets}


def near_copies():
    rng = random.Random(2)
    docs = []
    for _ in range(6):
        base = words(rng, 120)
        for share in (0, 0, 1, 2, 3, 5, 8, 12):
            copy = list(base)
            for at in rng.sample(range(120), share):
                copy[at] = "edit" + str(rng.randint(0, 999))
            docs.append(" ".join(copy))
    # A chain: each is near the next, the ends are not near each other.
    chain = words(rng, 200)
    for k in range(6):
        docs.append(" ".join(chain[6 * k:150 + 6 * k]))
    docs += ["", None, "one two", "ONE two", "one two three"] + [" ".join(words(rng, 80)) for _ in range(20)]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize(("outside", "everyone"), [(near_dup.OUTSIDE, near_dup.ALL), (2, 3)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, outside, everyone):
    monkeypatch.setattr(near_dup, "OUTSIDE", outside)
    monkeypatch.setattr(near_dup, "ALL", everyone)
    docs = near_copies()
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    sets = {i: shingles(t, 4) for i, t in docs}
    expected = smallest_linked(sets, 80)
    rows = near_dup.near_duplicates(frame, width=4).collect()
    assert {r.doc_id: r.component_id for r in rows} == expected
    assert all(r.kept == (r.doc_id == r.component_id) and r.n_shingles == len(sets[r.doc_id]) for r in rows)
    lonely = {i for i in sets if sum(c == expected[i] for c in expected.values()) == 1}
    assert all((r.n_links == 0) == (r.doc_id in lonely) for r in rows)


def test_short_sets_never_understate_the_common_part():
    rng = random.Random(3)
    for _ in range(200):
        # Few upper parts, so that different hashes often share one.
        a, b = ({rng.randrange(12) << 40 | rng.randrange(3) for _ in range(rng.randrange(1, 12))} for _ in range(2))
        upper = [near_dup.unpack_short(near_dup.pack_short(np.array(sorted(x), dtype=np.uint64))) for x in (a, b)]
        assert [u.tolist() for u in upper] == [sorted(h >> 40 for h in x) for x in (a, b)]
        assert near_dup._at_most_common(*upper) >= len(a & b)
    assert near_dup._at_most_common(np.array([1, 5], np.uint32), np.array([0, 5, 9], np.uint32)) == 1


def test_repeated_and_missing_ids_lose_no_link(spark):
    rng = random.Random(6)
    a, b, c = (words(rng, 60) for _ in range(3))
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(b + ["more"])), (3, " ".join(a + ["more"])), (None, " ".join(c)), (None, " ".join(c + ["x"])),
            (None, " ".join(a + ["y"])), (5, " ".join(words(rng, 40))), (5, "")]
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in found if r.doc_id) == [
        (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (5, 5, True), (5, 5, True)]
    assert sorted((r.component_id is None, r.kept) for r in found if r.doc_id is None) == [(False, False), (True, False), (True, True)]


def test_keys_follow_ids_and_carry_rows(spark):
    rows = [(k % 3 if k % 7 else None, f"text {k % 40}", k) for k in range(2000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, key int").repartition(5)
    for last in (False, True):
        found = common.keyed(frame, nulls_last=last, carry=True).orderBy("key").collect()
        assert [r.key for r in found] == list(range(2000))
        place = [(r.id is None) == last if r.id is None or last else True for r in found]
        ids = [r.id for r in found]
        assert ids == sorted(ids, key=lambda i: ((i is None) == last, i or 0)) and place
        assert sorted(r.row.key for r in found) == list(range(2000)) and all(r.row.text == r.text for r in found)


def test_near_duplicates_odd_rows(spark):
    rows = near_dup.near_duplicates(odd_docs(spark)).collect()
    assert len(rows) == len(ODD) and all(r.component_id == r.doc_id and r.kept for r in rows)
    assert near_dup.near_duplicates(odd_docs(spark).limit(0)).count() == 0


def test_stars_find_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 560)]
    root = {n: n for e in edges for n in e}
    for _ in range(len(root)):
        moved = False
        for u, v in edges:
            low = min(root[u], root[v])
            moved |= root[u] != low or root[v] != low
            root[u] = root[v] = low
        if not moved:
            break
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long"), Steps(spark, "test")).collect()}
    assert found == {n: c for n, c in root.items() if n in {x for e in edges if e[0] != e[1] for x in e}}


def repeats_by_brute_force(rows):
    seen, out = set(), {}
    for key, text in sorted(rows):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), dtype=bool)
        for k in range(len(raw) - 99):
            if raw[k:k + 100] in seen:
                gone[k:k + 100] = True
            seen.add(raw[k:k + 100])
        runs = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[key] = (len(raw), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("many", [suffix_dedup.MANY_CONTEXTS, 1])
def test_repeats_equal_brute_force(spark, many):
    rng = random.Random(5)
    base = "".join(rng.choice("abc ") for _ in range(400))
    rows = [(0, "a" * 500), (1, "a" * 130), (2, "ab" * 300), (3, base), (4, base[50:380]), (5, base[:90] + "!" + base[91:]),
            (6, ""), (7, None), (8, "é" * 200), (9, base[100:199]), (10, base[100:200])]
    rows += [(11 + k, "".join(rng.choice("ab") for _ in range(rng.randint(0, 30))) * rng.randint(1, 20) + base[rng.randint(0, 200):][:rng.randint(50, 200)]) for k in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(frame, many=many).collect()}
    assert found == repeats_by_brute_force(rows)


def test_long_documents_are_hashed_in_pieces():
    rng = random.Random(1)
    raw = bytes(rng.choice(b"abcd ") for _ in range(3000))
    whole = suffix_dedup.anchors(raw)
    for chunk in (37, 100, 999):
        for a, b in zip(whole, suffix_dedup.anchors(raw, chunk=chunk)):
            assert np.array_equal(a, b)


def test_repeats_odd_rows(spark):
    rows = suffix_dedup.remove_repeats(odd_docs(spark)).collect()
    assert len(rows) == len(ODD)
    assert next(r for r in rows if r.doc_id == 3).n_removed > 149_000
    twice = spark.createDataFrame([(1, "x" * 30 + "y" * 90)] * 2, "doc_id long, text string")
    assert sorted(r.n_removed for r in suffix_dedup.remove_repeats(twice).collect()) == [0, 120]
    assert suffix_dedup.remove_repeats(odd_docs(spark).limit(0)).count() == 0


def test_fingerprints_are_homomorphic():
    h = fingerprint.Hasher()
    one, two = "first line of words\nsecond line here\n\nlast", "last\n\nsecond line here\nfirst line of words"
    assert h.text(one).hex() == h.text(two).hex() != h.text(one + "\n").hex()
    assert (h.text("a b\nc d") - h.paragraphs(["c d"]) + h.paragraphs(["e"])).hex() == h.text("a b\ne").hex()
    again = fingerprint.Fingerprint.from_hex(h.text(one).hex())
    assert again.likeness(h.text(two)) == 1.0 and h.text("").hex() != h.text("\n").hex()


def test_edited_pairs_equal_brute_force(spark):
    rng = random.Random(8)
    docs = [(k * 3, "\n".join(" ".join(words(rng, rng.randint(0, 30))) for _ in range(rng.randint(1, 6)))) for k in range(60)] + [(1000, None), (1001, "ab")]
    rows = {r.doc_id: r for r in fingerprint.edited_pairs(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    h = fingerprint.Hasher()
    assert len(rows) == len(docs)
    for k, (i, text) in enumerate(docs):
        text, after = text or "", docs[(k + 1) % len(docs)][1] or ""
        taken = len(text) // 4
        edited = text[:len(text) - taken] + after[:taken]
        assert rows[i].n_chars == len(text) and rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert rows[i].fingerprint == h.text(text).hex() and rows[i].edited_fingerprint == h.text(edited).hex()
        assert 0 <= rows[i].near_next <= 1
        if len(text) > 300:
            assert rows[i].near_edited > 0.5 > rows[i].near_next


def test_edited_pairs_odd_rows(spark):
    assert fingerprint.edited_pairs(odd_docs(spark)).count() == len(ODD)
    (alone,) = fingerprint.edited_pairs(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).collect()
    assert alone.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and alone.near_next == 1.0
    assert fingerprint.edited_pairs(odd_docs(spark).limit(0)).count() == 0


def test_ids_equal_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Encoder()
    plain.encode_special_tokens = True
    rng = random.Random(3)
    bits = list("ab c  d\n\n\t\r\x0b\x0c\x85\xa0 　​\x1c\x1f'sé1２.,!-᠎﻿🙂ß")
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + ["It's 12 o'clock, isn't it?\nYes.", "<|endoftext|>"]
    for text in texts:
        assert np.frombuffer(own.ids(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_cost_packing_is_whole_and_balanced():
    rng = random.Random(9)
    lengths = [rng.choice([1, 5, 80, 300, 700, 1024, 3000]) for _ in range(400)]
    pieces, costs = cost_packing.pack_lengths(lengths, 1024)
    by_doc, by_sequence = {}, {}
    for k, start, n, sequence, offset in pieces:
        by_doc.setdefault(k, []).append((start, n))
        by_sequence.setdefault(sequence, []).append((offset, n))
    for group, sizes in ((by_doc, dict(enumerate(lengths))), (by_sequence, {s: sum(n for _, n in p) for s, p in by_sequence.items()})):
        for k, parts in group.items():
            at = 0
            for start, n in sorted(parts):
                assert start == at
                at += n
            assert at == sizes[k]
    assert len(costs) * 1024 - sum(lengths) < 1024 and max(sum(n for _, n in p) for p in by_sequence.values()) <= 1024


def test_packing_odd_rows(spark):
    rows = cost_packing.pack(odd_docs(spark)).collect()
    assert sum(r.length for r in rows if r.doc_id == 3) == next(r.doc_tokens for r in rows if r.doc_id == 3)
    assert [r.doc_tokens for r in rows if r.doc_id in (1, 2)] == [1, 1, 1]
    assert cost_packing.pack(odd_docs(spark).limit(0)).count() == 0


def test_best_fit_takes_the_tightest_row():
    rng = random.Random(10)
    lengths = [rng.randint(1, 250) for _ in range(300)]
    pieces, rows = token_output.best_fit_decreasing(lengths, 100)
    rooms = []
    for n in sorted((n % 100 for n in lengths if n % 100), reverse=True):
        fitting = [r for r in rooms if r >= n]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - n)
        else:
            rooms.append(100 - n)
    assert rows == len(rooms) + sum(n // 100 for n in lengths)
    assert sum(p[2] for p in pieces) == sum(lengths)


def test_token_files_give_the_ids_back(spark):
    rng = random.Random(11)
    docs = [(k, " ".join(words(rng, rng.randint(0, 400)))) for k in range(50)] + [(98, None), (99, "")]
    manifest = token_output.write_packed(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), length=256, block_tokens=9000)
    store, folder = pyarrow.fs.FileSystem.from_uri(manifest._packed_folder)
    files = {r.file: None for r in manifest.select("file").distinct().collect()}
    for name in files:
        files[name] = token_output.read_file(store.open_input_stream(f"{folder}/{name}").read())
    got: dict = {}
    for r in manifest.orderBy("start").collect():
        got.setdefault(r.doc_id, []).extend(files[r.file]["ids"][r.row][r.offset:r.offset + r.length].tolist())
        assert r.row * 256 + r.offset in files[r.file]["position_resets"]
    own = Encoder()
    for i, text in docs:
        assert got[i] == [*np.frombuffer(own.ids(text or ""), "<u4").tolist(), 0]
    held = next(iter(files.values()))
    at = token_output.position_ids(held["position_resets"], held["ids"].size)
    assert all(at[p] == 0 for p in held["position_resets"]) and held["cumulative_lengths"][-1] == sum(np.diff(held["cumulative_lengths"]))
    assert token_output.write_packed(odd_docs(spark).limit(0)).count() == 0
    assert token_output.write_packed(odd_docs(spark)).select("doc_id").distinct().count() == 6


def test_archives_round_trip(spark):
    long, small = "<p>" + "x" * 200, "tiny"
    pages = [(k, f"http://a/{k}", h) for k, h in enumerate([long, small, long, small, None, "", long, "é" * 60, "é" * 60, "a\r\n\r\nb" * 40])]
    frame = spark.createDataFrame([(*p, "x") for p in pages] + [(0, "again", long, "x"), (None, None, long, "x")], "page_id long, url string, html string, digest string")
    rows = warc.round_trip(frame.repartition(3)).collect()
    assert len(rows) == len(pages) + 2
    by_id = {r.page_id: r for r in rows if r.url != "again"}
    for k, _, html in pages:
        raw = (html or "").encode()
        assert by_id[k].payload_bytes == len(raw) and by_id[k].payload_digest == hashlib.sha256(raw).hexdigest()
        first = min(j for j, _, other in pages if (other or "") == (html or ""))
        target = first if first < k and len(raw) >= 100 else None
        assert (by_id[k].record_type, by_id[k].refers_to) == ("revisit" if target is not None else "response", target)
    assert by_id[None].record_type == "response"
    assert warc.round_trip(frame.limit(0)).count() == 0


def test_salvage_recovers_what_follows_damage():
    records = [warc.record_bytes(k, "http://x", bytes([65 + k]) * 500, None) for k in range(5)]
    members = [warc.member(r) for r in records]

    def read(data):
        reader = warc.SalvageReader(io.BytesIO(data))
        return [r.page() for r in reader], [(g.start, g.end) for g in reader.gaps]

    ends = list(itertools.accumulate(map(len, members), initial=0))
    assert read(b"".join(members)) == ([0, 1, 2, 3, 4], [])
    flipped = bytearray(b"".join(members))
    flipped[ends[2] + 40] ^= 0xFF
    assert read(bytes(flipped)) == ([0, 1, 3, 4], [(ends[2], ends[3])])
    cut = b"".join(members[:2]) + members[2][:30] + members[3] + b"junk" + members[4][:-5]
    ids, gaps = read(cut)
    assert ids == [0, 1, 3] and gaps[0] == (ends[2], ends[2] + 30) and gaps[1][1] == len(cut)
    plain = records[0] + b"garbage " + records[1] + records[2].replace(b"C", b"D", 1) + records[3]
    ids, gaps = read(plain)
    assert 0 in ids and 1 in ids and 3 in ids and gaps[0] == (len(records[0]), len(records[0]) + 8)


def test_long_urls_round_trip(spark):
    pages = [(k, "data:" + "u" * size, "<p>" + str(k)) for k, size in enumerate((10, 65_000, 66_000, 300_000))]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {(r.page_id, r.url) for r in warc.round_trip(frame).collect()} == {(k, url) for k, url, _ in pages}
    plain = b"".join(warc.record_bytes(k, url, html.encode(), None) for k, url, html in pages)
    assert [r.page() for r in warc.SalvageReader(io.BytesIO(plain))] == [0, 1, 2, 3]


def test_members_of_several_records_are_read():
    rng = random.Random(1)
    records = [warc.record_bytes(k, "http://x", rng.randbytes(50_000), None) for k in range(20)]

    def read(data):
        reader = warc.SalvageReader(io.BytesIO(data))
        return [r.page() for r in reader], reader.gaps

    whole, single = warc.member(b"".join(records[:19])), warc.member(records[19])
    assert read(whole + single) == (list(range(20)), [])
    # A bad record inside of a sound member costs only itself.
    spoiled = bytearray(b"".join(records[:19]))
    spoiled[spoiled.index(b"<urn:page:7>") + 5_000] ^= 0xFF
    ids, gaps = read(warc.member(bytes(spoiled)) + single)
    assert ids == [k for k in range(20) if k != 7]
    assert [(g.start, g.end, "digest differs" in g.reason) for g in gaps] == [(0, len(warc.member(bytes(spoiled))), True)]
    # A member that breaks off gives the records before.
    ids, gaps = read(whole[:len(whole) // 2] + single)
    assert ids[:-1] == list(range(len(ids) - 1)) and len(ids) > 9 and ids[-1] == 19
    assert len(gaps) == 1 and 0 < gaps[0].start < gaps[0].end == len(whole) // 2
    # Also where the damage lies in the same piece that was read.
    small = [warc.record_bytes(k, "http://x", b"%d" % k * 200, None) for k in range(20)]
    whole = bytearray(warc.member(b"".join(small)))
    whole[-6] ^= 0xFF
    ids, gaps = read(bytes(whole) + single)
    assert ids == [*range(20), 19] and [g.end for g in gaps] == [len(whole)]


def test_round_trip_fails_on_lost_records(spark, tmp_path):
    frame = spark.createDataFrame([(k, "http://x", "y" * 50) for k in range(5)], "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_archives(frame, f"file://{tmp_path}")
    assert warc.read_archives(manifest, counts="n_records").count() == 5
    (row,) = manifest.where("n_records > 0").collect()
    more = spark.createDataFrame([(row.path, row.n_records + 1)], "path string, n_records long")
    with pytest.raises(Exception, match="5 of 6 records"):
        warc.read_archives(more, counts="n_records").count()



def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    item = " ".join(f"q{k}" for k in range(30))
    bad = ["grumbler", "snotface", "dolt"]
    docs, labels = [], []
    for k in range(200):
        text = words(rng, 70)
        if k % 5 == 0:
            for at in (3, 20, 40, 55):
                text[at] = rng.choice(bad)
        docs.append((k, " ".join(text)))
        labels.append((k, 1, int(k % 5 == 0)))
    docs += [(300, docs[1][1]), (301, docs[2][1] + " more"), (302, "some words " + item + " after"), (303, "mail me a@b.org"), (304, None), (305, "")]
    # Rows without an id: a near copy of a clean text, a benchmark passage, and a clean text of its own.
    lost = [docs[3][1] + " tail", " ".join(words(rng, 30)) + " " + item, " ".join(words(rng, 50))]
    docs += [(None, t) for t in lost]
    tables = {
        "documents": spark.createDataFrame([(i, t, "en", "s", len(t or ""), "extra") for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long, toxicity string"),
        "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, item)], "item_id long, text string"),
    }
    for name, frame in tables.items():
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    docs_now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept, without = [], []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs_now, str(tmp_path))
        assert out.columns == docs_now.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs_now = spark.read.parquet(f"{tmp_path}/{name}")
        held = docs_now.collect()
        assert all(r.toxicity == "extra" for r in held)
        kept.append({r.doc_id for r in held if r.doc_id is not None})
        without.append([t for t in lost if any(r.text == t for r in held)])
    toxic = {k for k in range(0, 200, 5)}
    everything = {i for i, _ in docs if i is not None}
    assert without == [lost, lost[1:], lost[2:], lost[2:]]
    assert kept[0] == everything - toxic
    assert kept[1] == kept[0] - {300, 301} and kept[2] == kept[1] - {302} and kept[3] == kept[2]
    assert next(r.text for r in docs_now.collect() if r.doc_id == 303) == "mail me [EMAIL]"
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows if r.doc_id is not None} == kept[3]
