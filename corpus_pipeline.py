"""The corpus pipeline: toxicity, near duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread
as the docs of the next one. All but the last return the columns of ``documents``.

Defined results: a null or empty text is kept by the first three stages (no hits, no shingles, no
benchmark words) and becomes one piece with only the end id. Where ids repeat or are missing, each row is
a document of its own in every stage, so of equal rows with words one stays, and a row without an id that
holds a benchmark passage goes. Extra columns of documents pass through, whatever their names. An empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epiwake.llm import cost_packing, decontaminate, near_dup, pii, toxicity
from epiwake.llm.common import Steps, keyed, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator predicts as toxic go."""
    scorer = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score_of(scorer)(F.coalesce("text", F.lit(""))) < toxicity.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: the one with the smallest id."""
    numbered = keyed(docs, nulls_last=True, carry=True)
    gone = near_dup.components(numbered.drop("row"), width=5, percent=80).where("key <> root").select("key")
    return numbered.join(gone, "key", "left_anti").select("row.*")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    numbered = keyed(docs, carry=True)
    texts = numbered.select(F.col("key").alias("doc_id"), "text")
    gone = decontaminate.find(texts, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("key")).distinct()
    return numbered.join(gone, "key", "left_anti").select("row.*")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; ``n_chars`` follows the text."""
    masked = pii.masked(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast("long"))
    return masked.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all remaining documents in sequences of balanced cost: a row per piece."""
    return cost_packing.pack(docs, length=1024)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dup", drop_near_duplicates),
    ("decontaminate", drop_benchmark),
    ("pii", mask_personal_data),
    ("packing", pack),
]

#: The stages learn from labels, hash and tokenize, which SQL cannot express; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored below ``spark.checkpoint.dir`` before the next."""
    steps = Steps(spark, "corpus-pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = steps.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
