"""Operators that look at each text on its own: personal data, licenses, toxicity, benchmark passages."""

import hashlib
import random
import re
import time

import numpy as np
import pytest

from epiwake.llm import decontaminate, license_scan, pii, toxicity

ODD = [(1, ""), (2, None), (3, "word " * 30_000), (None, "plain text"), (1, ""), (4, "\x1c\n\t é 🙂")]


def odd_docs(spark):
    """Nulls, repeated rows, empty and long texts, and an extra column with a clashing name."""
    return spark.createDataFrame([(i, t, "x", 5) for i, t in ODD], "doc_id long, text string, key string, score int")


def base_spans(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 13 <= len(digits) <= 19 and sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0:
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append(("phone", *m.span()))
    return found


def test_pii_base_spans_equal_the_plain_patterns():
    rng = random.Random(7)
    bits = ["a", "@", ".", "-", "+", "1", "23", "256", "0007", " ", "(", ")", "_", "é", "4111111111111111", "x@y.z"]
    for _ in range(5000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        assert [(s.kind, s.start, s.end) for s in pii.spans_of(text) if s.kind in pii.BASE_KINDS] == base_spans(text), text


def test_pii_added_kinds_need_checksum_or_context():
    def kinds(text):
        return [s.kind for s in pii.spans_of(text)]

    assert "iban" in kinds("IBAN DE89 3704 0044 0532 0130 00 please")
    assert "iban" not in kinds("IBAN DE88 3704 0044 0532 0130 00 please")
    assert kinds("her SSN is 078-05-1120") == ["national_id"]
    assert kinds("part 078-05-1120") == []
    near, far = (pii.spans_of(t)[0].score for t in ("card 4111111111111111", "4111111111111111"))
    assert near > far
    assert pii.mask("mail a@b.org now") == "mail [EMAIL] now"
    assert pii.mask(None) is None


def test_pii_odd_rows(spark):
    rows = pii.find(odd_docs(spark)).collect()
    assert len(rows) == len(ODD)
    assert all(r.base_sha256 == hashlib.sha256(b"").hexdigest() and r.spans == "" for r in rows)
    assert pii.find(odd_docs(spark).limit(0)).count() == 0
    long = "1" * 200_000 + "a" * 200_000 + "@" + "+" * 1000
    assert pii.spans_of(long) == []


def test_pii_time_grows_with_the_spans():
    began = time.time()
    assert len(pii.spans_of("call +49 30 1234567 or 555-123-4567, " * 8000)) == 16_000
    assert time.time() - began < 10


def test_patience_recovers_edited_templates():
    scanner = license_scan.Scanner()
    text = license_scan.TEMPLATES["MIT"]
    assert [m.license for m in scanner.scan("head words " + text + " tail")] == ["MIT"]
    changed = text.replace("without restriction", "w/o limits").replace("merge, ", "")
    (found,) = scanner.scan(changed)
    assert found.license == "MIT" and 0.8 <= found.coverage < 1
    assert [m.license for m in scanner.scan("x\nReleased under the MIT License.\ny")] == ["MIT notice"]
    assert scanner.scan("this software is a word and so is license") == []
    pairs = license_scan.patience(list("abcxdef"), list("abyccdef"))
    assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))


def test_license_odd_rows(spark):
    rows = license_scan.scan(odd_docs(spark)).collect()
    assert len(rows) == len(ODD) and all(r.n_licenses == 0 for r in rows)
    assert license_scan.scan(odd_docs(spark).limit(0)).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def test_automaton_meets_trie_like_edit_distance():
    rng = random.Random(3)
    terms = {"".join(rng.choice("abc") for _ in range(rng.randint(3, 12))): 1.0 for _ in range(40)}
    trie = toxicity.Trie(terms)
    for _ in range(3000):
        word = rng.choice(list(terms)) if rng.random() < 0.6 else "".join(rng.choice("abc") for _ in range(rng.randint(1, 13)))
        letters = list(word)
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(letters) + 1)
            letters[at:at + rng.randint(0, 1)] = rng.choice(["", "a", "z"])
        word = "".join(letters)
        # Words under eight letters are matched with one error at most.
        best = min((d for t in terms if (d := edit_distance(t, word)) <= toxicity.allowed_errors(len(t)) and (d < 2 or len(word) > 7)), default=None)
        found = trie.match(word) if word else None
        assert (found[1] if found else None) == best, (word, found, best)


def toxic_world(spark):
    rng = random.Random(1)
    plain = ["alpha", "bravo", "carbon", "delta", "echoes", "forest", "garden", "harbor"]
    docs, labels = [], []
    for k in range(400):
        words = [rng.choice(plain) + str(rng.randint(0, 40)) for _ in range(60)]
        toxic = k % 5 == 0
        if toxic:
            for at in rng.sample(range(60), 3):
                words[at] = rng.choice(["grumbler", "snotface"])
        docs.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return (spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_toxicity_learns_misspells_and_quotes(spark):
    docs, labels = toxic_world(spark)
    scorer = toxicity.fit(docs, labels)
    rows = {r.doc_id: r for r in toxicity.score(docs, scorer).collect()}
    held = [r for r in rows.values() if r.held_out]
    assert held and all(r.predicted == (r.doc_id % 5 == 0) for r in held)
    assert scorer.matched("gxumbler") == ("grumbler", 1) and scorer.matched("grumpy") is not None
    filler = " alpha1 bravo2 carbon3 delta4 echoes5 forest6 garden7 harbor8" * 3
    abuse = scorer.features("you grumbler" + filler)
    quoted = scorer.features('he said "grumbler"' + filler)
    assert abuse[0] > 0 == quoted[0] and quoted[3] > 0
    assert scorer.score("you grumbler snotface" + filler) > scorer.score(filler)
    odd = toxicity.score(odd_docs(spark), scorer).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)


def test_toxicity_without_labels(spark):
    docs, labels = toxic_world(spark)
    for some in (labels.limit(0), labels.where("toxic = 0"), labels.selectExpr("doc_id", "cast(null as int) as toxic")):
        assert {round(r.score, 6) for r in toxicity.score(docs, toxicity.fit(docs, some)).collect()} == {0.1}
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0


@pytest.fixture(scope="module")
def benchmark(spark):
    rng = random.Random(5)
    items = [(k, " ".join(f"w{rng.randint(0, 500)}" for _ in range(rng.randint(14, 40)))) for k in range(20)]
    items += [(20, "tiny item here"), (21, ""), (22, None)]
    return items, spark.createDataFrame(items, "item_id long, text string")


def test_decontaminate_finds_copies_and_replaced_words(spark, benchmark):
    items, table = benchmark
    rng = random.Random(6)
    noise = lambda n: [f"n{rng.randint(0, 5000)}" for _ in range(n)]
    docs, expected = [], set()
    for k, (item_id, text) in enumerate(items[:20]):
        words = text.upper().split()
        docs.append((3 * k, " ".join(noise(50) + words + noise(50))))
        expected.add((3 * k, item_id))
        spoiled = [w if j % 6 != 5 else "other" for j, w in enumerate(words)]
        docs.append((3 * k + 1, " ".join(noise(9) + spoiled + noise(9))))
        if len(words) >= 20:
            expected.add((3 * k + 1, item_id))
        docs.append((3 * k + 2, " ".join(noise(120))))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    hits = {(r.doc_id, r.item_id) for r in decontaminate.find(frame, table).collect()}
    assert expected <= hits
    assert all(d % 3 != 2 for d, _ in hits)
    # Small blocks: several passes find the same.
    assert {(r.doc_id, r.item_id) for r in decontaminate.find(frame, table, block_chars=500).collect()} == hits
    flagged = {r.doc_id for r in decontaminate.flags(frame, decontaminate.find(frame, table)).collect() if r.contaminated}
    assert flagged == {d for d, _ in hits}


def test_decontaminate_odd_rows(spark, benchmark):
    _, table = benchmark
    rows = decontaminate.flags(odd_docs(spark), decontaminate.find(odd_docs(spark), table)).collect()
    assert len(rows) == len(ODD) and not any(r.contaminated for r in rows)
    short = spark.createDataFrame([(1, "a Tiny, item here."), (2, "tiny item")], "doc_id long, text string")
    assert {r.doc_id for r in decontaminate.find(short, table).collect()} == {1}
    assert decontaminate.find(short, table.limit(0)).count() == 0
    assert decontaminate.find(short.limit(0), table).count() == 0


def test_decontaminate_counts_all_runs_of_a_diagonal(spark):
    item = [f"w{k}" for k in range(30)]
    holed = item[:12] + [f"x{k}" for k in range(6)] + item[18:]
    # After 9 replaced words the weight is still above zero, so the last run belongs to the same rise.
    longer = [f"v{k}" for k in range(41)]
    risen = longer[:20] + [f"x{k}" for k in range(9)] + longer[29:]
    docs = spark.createDataFrame([(1, " ".join(holed)), (2, " ".join(risen)), (3, " ".join(item[:12]))], "doc_id long, text string")
    table = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(longer))], "item_id long, text string")
    found = {(r.doc_id, r.item_id, r.matched, r.replaced, r.doc_word_start, r.doc_word_end) for r in decontaminate.find(docs, table).collect()}
    assert found == {(1, 7, 24, 0, 0, 30), (2, 8, 32, 0, 0, 41)}


def test_decontaminate_segments_equal_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        same = [rng.random() < rng.choice((0.4, 0.7, 0.9)) for _ in range(rng.randint(1, 40))]

        def heaviest(low, high):
            spans = [(sum(1 if x else -decontaminate.REPLACED_COST for x in same[a:b]), -(b - a), -a) for a in range(low, high) for b in range(a + 1, high + 1)]
            weight, length, start = max(spans, default=(0, 0, 0))
            if weight <= 0:
                return []
            return heaviest(low, -start) + [(-start, -start - length)] + heaviest(-start - length, high)

        item = np.arange(len(same), dtype=np.uint64)
        words = np.where(same, item, item + np.uint64(1000))
        expected = [(a, b) for a, b in heaviest(0, len(same)) if sum(same[a:b]) >= min(decontaminate.MIN_SEGMENT, len(same))]
        assert [(a, b) for _, a, b, _ in decontaminate.segments(words, item, 0)] == expected


def test_decontaminate_searches_every_text_of_the_benchmark(spark):
    texts = [" ".join(f"{c}{k}" for k in range(20)) for c in "abcd"]
    table = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (None, texts[3])], "item_id long, text string")
    docs = spark.createDataFrame([*enumerate(texts), (4, " ".join(texts))], "doc_id long, text string")
    for chars in (100, decontaminate.BLOCK_CHARS):
        rows = {r.doc_id: r for r in decontaminate.flags(docs, decontaminate.find(docs, table, block_chars=chars)).collect()}
        assert [rows[k].n_items for k in range(5)] == [1, 1, 1, 1, 3]


def test_long_words_are_compared_with_stems():
    scorer = toxicity.Scorer({"grum*": 3.0, "dolt": 2.0}, [0.0] * 7)
    assert scorer.matched("grumbler" * 6) == ("grum*", 0)
    assert scorer.matched("x" * 41) is None
