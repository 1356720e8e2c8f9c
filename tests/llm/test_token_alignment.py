"""Alignment of two tokenizers: ends by set intersection, groups and counts by plain loops."""

import collections
import hashlib
import random

import numpy as np
import pytest

from epiwake.llm import token_alignment
from epiwake.llm.tokens import vocabulary_path


def test_matched_ends_equal_the_intersection():
    rng = random.Random(3)
    for _ in range(3000):
        size = rng.randint(1, 80)
        dense = rng.choice([0.05, 0.3, 0.9, 1.0])
        a, b = ({k for k in range(1, size) if rng.random() < dense} | {size} for _ in range(2))
        if rng.random() < 0.5:
            b = (a ^ {k for k in range(1, size) if rng.random() < 0.05}) | {size}
        a, b = np.array(sorted(a)), np.array(sorted(b))
        in_a, in_b = token_alignment.matched_ends(a, b)
        common, want_a, want_b = np.intersect1d(a, b, return_indices=True)
        assert in_a.tolist() == want_a.tolist() and in_b.tolist() == want_b.tolist()


def plain(texts):
    """(rows, counts of linked pairs) by loops over the tokenizers' own files."""
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in visible)}
    rows, counts = [], collections.Counter()
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in tok.id_to_token(k)) for k in a]
        bytes_b = [bytes([int(sp.id_to_piece(k)[3:5], 16)]) if sp.is_byte(k) else sp.id_to_piece(k).replace("▁", " ").encode() for k in b]
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            rows.append((0, 0, 0, [], ""))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        groups, links, low = [], [], (0, 0)
        for end in sorted(set(ends_a) & set(ends_b)):
            i, j = ends_a.index(end), ends_b.index(end)
            groups.append(",".join(map(str, a[low[0]:i + 1])) + "|" + ",".join(map(str, b[low[1]:j + 1])))
            links.append((a[i], b[j]))
            low = i + 1, j + 1
        counts.update(links)
        rows.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return rows, counts


TEXTS = ["", None, " ", "Hello world, hello  world!", "<|endoftext|> <s> </s>", "a▁b", "tab\tline\r\n\n  x", "éè \U0001f642 ﬁ ́a",
         "straße naïve 東京 123456", "same words again", "same words again", "x" * 3000, "\x00 null", " lead", "trail "]


@pytest.mark.parametrize("block_links", [10, 1 << 20])
def test_rows_equal_plain_loops(spark, block_links):
    data = [(None if k == 3 else k // 2, t) for k, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in data], "doc_id long, text string, block string, n_a int").repartition(3)
    want, counts = plain(TEXTS)
    highest = collections.defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    expected = [(i, a, b, g, g, sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), sha)
                for (i, _), (a, b, g, links, sha) in zip(data, want)]
    got = [tuple(r) for r in token_alignment.align(docs, block_links=block_links).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(expected, key=key)


def test_whole_smoke_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(texts)
    want, counts = plain([texts[i] for i in ids])
    got = {r.doc_id: r for r in token_alignment.align(docs).collect()}
    for i, (a, b, g, links, sha) in zip(ids, want):
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.groups_sha256, r.count_sum) == (a, b, g, sha, sum(counts[x] for x in links))


def test_empty_table(spark):
    assert token_alignment.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_full_block_is_small():
    import tracemalloc

    block = token_alignment.Block(0)
    rng = np.random.default_rng(1)
    while block.n_links < token_alignment.BLOCK_LINKS:
        block.add((1, 1, 1, 1, 1, ""), rng.integers(0, 1 << 40, 50_000))
    tracemalloc.start()
    list(block.rows())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Six such tasks share an executor with their tokenizers.
    assert peak < 250 << 20


def test_stored_blocks_are_few_per_row_group(spark, tmp_path, monkeypatch):
    # A block is a row of megabytes, and a row group is held whole; Parquet would put 100 rows and more into one.
    import pyarrow.parquet as pq

    from epiwake.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    docs = spark.createDataFrame([(k, f"word {k}") for k in range(60)], "doc_id long, text string").coalesce(1)
    assert token_alignment.align(docs, block_links=1).count() == 60
    files = [pq.ParquetFile(f).metadata for f in tmp_path.rglob("*-blocks/part*.parquet")]
    groups = [m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)]
    assert sum(groups) == 60 and max(groups) <= 4
