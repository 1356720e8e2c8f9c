"""Normalisation of legacy values, as transforms that can run before any load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epiwake.functions.clinical import literal_map

# Legacy spellings.
FEMALE_WORDS = ["female", "f", "أنثى", "انثى"]
CURED_WORDS = ["cured", "recovered", "recovery", "healed", "شفاء", "متعافي"]
WORK_WORDS = ["work", "office", "job", "عمل"]
MARITAL_WORDS = {
    "divorced": "divorced",
    "single": "single",
    "married": "married",
    "widow(er)": "widow",
    "widow": "widow",
    "widower": "widow",
    "widowed": "widow",
    "مطلق": "divorced",
    "مطلقة": "divorced",
    "اعزب": "single",
    "عازب": "single",
    "عزباء": "single",
    "متزوج": "married",
    "متزوجة": "married",
    "ارمل": "widow",
    "أرمل": "widow",
    "ارملة": "widow",
    "أرملة": "widow",
}


def _word(col: Column) -> Column:
    return F.lower(F.trim(F.coalesce(col, F.lit(""))))


def fix_role(col: Column) -> Column:
    return F.when(col.isin("admin", "doctor"), col).otherwise("doctor")


def fix_gender(col: Column) -> Column:
    return F.when(_word(col).isin(FEMALE_WORDS), "female").otherwise("male")


def fix_status(col: Column) -> Column:
    return F.when(_word(col).isin(CURED_WORDS), "cured").otherwise("infected")


def fix_region(col: Column) -> Column:
    return F.when(_word(col).isin(WORK_WORDS), "work").otherwise("home")


def fix_marital(col: Column) -> Column:
    return F.coalesce(literal_map(MARITAL_WORDS)[_word(col)], F.lit("single"))


def merge_histories(histories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One history per patient, and the (old id, kept id) map for the child tables."""
    kept = histories.groupBy("patient_id").agg(
        F.min("id").alias("kept_id"),
        F.max("has_surgical_metal_plates").alias("has_surgical_metal_plates"),
    )
    merged = kept.select(F.col("kept_id").alias("id"), "patient_id", "has_surgical_metal_plates")
    id_map = histories.select(F.col("id").alias("history_id"), "patient_id").join(
        kept.select("patient_id", "kept_id"), "patient_id"
    ).select("history_id", "kept_id")
    return merged, id_map


def repoint(child: DataFrame, id_map: DataFrame) -> DataFrame:
    """Move the rows of a child table to the history that was kept."""
    moved = child.join(id_map.filter("history_id <> kept_id"), "history_id", "left")
    return moved.withColumn("history_id", F.coalesce("kept_id", "history_id")).drop("kept_id").select(
        *child.columns
    )
