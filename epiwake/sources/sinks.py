"""Outputs: training files, GeoJSON features and model artifacts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epiwake.operators.datasets import disease_region_day, visit_level
from epiwake.operators.risk import FEATURES
from epiwake.tables import Tables


def export_datasets(t: Tables, folder: str) -> DataFrame:
    """Write both training datasets as CSV folders and report path and row count of each.

    Rows come out range-partitioned by their order, so the part files read in sequence are
    sorted without any single writer.
    """
    spark = t.visit.sparkSession
    outputs = {
        "visit_level_dataset": (visit_level(t), ["visit_id"]),
        "disease_region_day_dataset": (disease_region_day(t), ["diagnosis_date", "disease_code", "region_type"]),
    }
    rows = []
    for name, (df, order) in outputs.items():
        path = f"{folder}/{name}"
        df.orderBy(*order).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")
        rows.append((name, path, spark.read.csv(path, header=True).count()))
    return spark.createDataFrame(rows, "dataset string, path string, row_count long")


def features(cases: DataFrame) -> DataFrame:
    """One GeoJSON feature text per map case."""
    names = [c for c in cases.columns if c not in ("latitude", "longitude")]
    properties = F.struct(F.col("geodata_id").alias("id"), *names)
    return cases.select(
        "geodata_id",
        F.to_json(
            F.struct(
                F.lit("Feature").alias("type"), F.col("geodata_id").alias("id"),
                F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates")).alias("geometry"),
                properties.alias("properties"),
            )
        ).alias("feature"),
    )


def feature_collection(cases: DataFrame, most: int = 10_000) -> DataFrame:
    """The collection document of one map page; ``write_features`` is for feeds without a limit.

    A page of more than ``most`` cases is refused, because the document is one row.
    """
    if len(cases.select("geodata_id").take(most + 1)) > most:
        raise ValueError(f"a page holds at most {most} cases; write longer feeds as lines")
    listed = features(cases).agg(
        F.sort_array(F.collect_list(F.struct("geodata_id", "feature"))).alias("f")
    )
    body = F.array_join(F.transform("f", lambda x: x.feature), ",")
    return listed.select(
        F.concat(
            F.lit('{"type":"FeatureCollection","features":['), body, F.lit('],"count":'),
            F.size("f").cast("string"), F.lit("}"),
        ).alias("document")
    )


def write_features(cases: DataFrame, path: str) -> None:
    features(cases).select("feature").write.mode("overwrite").text(path)


def save_centroids(artifact: DataFrame, path: str) -> None:
    artifact.withColumns(
        {"algorithm": F.lit("centroid_classifier"), "created_at": F.current_timestamp()}
    ).write.mode("overwrite").parquet(path)


def load_centroids(spark: SparkSession, path: str) -> DataFrame:
    try:
        artifact = spark.read.parquet(path)
    except AnalysisException as missing:
        raise FileNotFoundError(f"no risk model at {path}") from missing
    row = artifact.first()
    if row is None or row["feature_names"] != FEATURES:
        raise ValueError("the stored risk model has no classes or another feature list")
    return artifact
