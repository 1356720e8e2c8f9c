"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import conversation_repair, cost_packing, decontaminate, fingerprint, license_scan, near_dup, pii, secrets, suffix_dedup, token_alignment, token_output, toxicity, warc
from .common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    spans = F.transform("matches", lambda m: F.format_string("%s:%d:%d:%.4f", m["license"], m["start"], m["end"], m["coverage"]))
    return found.withColumn("matches", F.concat_ws(",", spans))


def op3_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_pairs(table(spark, sf_dir, "documents"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of the written files, without the file names, which differ between attempts."""
    return token_output.write_packed(table(spark, sf_dir, "documents")).drop("file").withColumnRenamed("row", "row_in_block")


def op7_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost_packing.pack(table(spark, sf_dir, "documents"), length=1024)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return decontaminate.flags(docs, decontaminate.find(docs, table(spark, sf_dir, "benchmark")))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = globals()
    named = [name for name in own if name.startswith("op")]
    ordered = {name: own[name] for name in sorted(named, key=lambda n: int(n[2:].split("_")[0]))}
    return {**ordered, "pipeline": corpus_pipeline.run}


# Rows of ``op4_warc`` by SQL; operators without a statement here cannot be stated in it and are tested by brute force.
WARC_SQL = """
WITH own AS (
    SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
    FROM pages
), first AS (
    SELECT payload_digest, min(page_id) AS first_id FROM own WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT own.page_id, own.payload_bytes, own.payload_digest,
       CASE WHEN first.first_id < own.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first.first_id < own.page_id THEN first.first_id END AS refers_to, own.url
FROM own LEFT JOIN first USING (payload_digest)
"""


# Rows of ``op13_conversation_repair``: dynamic programming from the last row, four roles before a row.
REPAIR_SQL = """
WITH RECURSIVE numbered AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
    FROM conversations
), crc AS (
    SELECT *, xor(list_reduce(
               [4294967295::BIGINT] || flatten(list_transform(string_split(key, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
               lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) ELSE xor(acc >> 1, (acc & 1) * 3988292384) END), 4294967295) % 20 AS kind
    FROM numbered
), damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(range(CASE WHEN kind = 0 THEN 0 WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
    FROM crc
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
           rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
    FROM damaged
), judged AS (
    SELECT *, CASE WHEN body = '' THEN 'blank'
                   WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
                   WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
           left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before
    FROM placed
), ids AS (
    SELECT conv_id, count(n) AS size, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN judged USING (conv_id)
    GROUP BY conv_id
), steps AS (
    SELECT conv_id, size AS n, {'c': 0::BIGINT, 'e': '', 'r': []::VARCHAR[]} AS b0, {'c': 6::BIGINT, 'e': 'II', 'r': ['user:', 'assistant:']} AS bs,
           {'c': 3::BIGINT, 'e': 'I', 'r': ['assistant:']} AS bu, {'c': 0::BIGINT, 'e': '', 'r': []::VARCHAR[]} AS ba
    FROM ids
    UNION ALL
    SELECT conv_id, n,
           least(r0, {'c': ru.c + 3, 'e': 'I' || ru.e, 'r': ['user:'] || ru.r}, {'c': ra.c + 6, 'e': 'II' || ra.e, 'r': ['user:', 'assistant:'] || ra.r}),
           least(rs, {'c': ru.c + 3, 'e': 'I' || ru.e, 'r': ['user:'] || ru.r}, {'c': ra.c + 6, 'e': 'II' || ra.e, 'r': ['user:', 'assistant:'] || ra.r}),
           least(ru, {'c': ra.c + 3, 'e': 'I' || ra.e, 'r': ['assistant:'] || ra.r}),
           least(ra, {'c': ru.c + 3, 'e': 'I' || ru.e, 'r': ['user:'] || ru.r})
    FROM (
        SELECT s.conv_id, s.n - 1 AS n,
               least({'c': b0.c + 4, 'e': 'D' || b0.e, 'r': b0.r}, ks, ku, {'c': bu.c + 3 + stay, 'e': 'R' || bu.e, 'r': ['user:' || text] || bu.r}) AS r0,
               least({'c': bs.c + 4, 'e': 'D' || bs.e, 'r': bs.r}, ku, {'c': bu.c + 3 + stay, 'e': 'R' || bu.e, 'r': ['user:' || text] || bu.r}) AS rs,
               least({'c': bu.c + 4, 'e': 'D' || bu.e, 'r': bu.r}, ka, {'c': ba.c + 3 + stay, 'e': 'R' || ba.e, 'r': ['assistant:' || text] || ba.r}) AS ru,
               least({'c': ba.c + 4, 'e': 'D' || ba.e, 'r': ba.r}, ku, {'c': bu.c + 3 + stay, 'e': 'R' || bu.e, 'r': ['user:' || text] || bu.r}) AS ra
        FROM (
            SELECT s.*, j.text, x.stay,
                   {'c': bs.c + x.stay + CASE WHEN initial = 's' THEN 0 ELSE 1000000000 END, 'e': 'K' || bs.e, 'r': [role || ':' || text] || bs.r} AS ks,
                   {'c': bu.c + x.stay + CASE WHEN initial = 'u' THEN 0 ELSE 1000000000 END, 'e': 'K' || bu.e, 'r': [role || ':' || text] || bu.r} AS ku,
                   {'c': ba.c + x.stay + CASE WHEN initial = 'a' THEN 0 ELSE 1000000000 END, 'e': 'K' || ba.e, 'r': [role || ':' || text] || ba.r} AS ka
            FROM steps s JOIN judged j ON j.conv_id IS NOT DISTINCT FROM s.conv_id AND j.n = s.n,
                 LATERAL (SELECT CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000000 WHEN fault = 'truncated' THEN 3 ELSE 0 END AS stay) x
        ) s
    )
)
SELECT ids.conv_id, gaps, blank, duplicate, truncated, illegal, b0.c AS cost, b0.e AS audit,
       sha256(array_to_string(b0.r, chr(10))) AS repaired_sha256
FROM ids JOIN steps ON steps.conv_id IS NOT DISTINCT FROM ids.conv_id AND steps.n = 0
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": WARC_SQL, "op13_conversation_repair": REPAIR_SQL}
