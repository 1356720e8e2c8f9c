"""Visit risk features, labels and the nearest-centroid model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epiwake.functions.clinical import age_years, is_active_report, risk_abnormal, risk_bmi
from epiwake.functions.geo import distance_km
from epiwake.operators.active import active_visits, flag_active
from epiwake.operators.datasets import labs_by_visit, points_by_visit, reports_by_visit
from epiwake.operators.outbreak import contexts_of, evaluate_outbreaks
from epiwake.operators.policy import alert_policies
from epiwake.session import cut_lineage, shuffled
from epiwake.tables import Tables

# Label order, policy profiles and the feature names.
LABELS = ["low", "medium", "high", "critical"]
PROFILES = [
    "general", "high_priority", "rare", "cluster_sensitive", "surge_sensitive",
    "environmental_signal",
]
FEATURES = [
    "disease_risk_level", "disease_infection_score", "disease_high_priority", "disease_rare",
    "patient_age_years", "bmi", "geodata_count", "has_home_geodata", "has_work_geodata",
    "total_lab_test_count", "abnormal_lab_test_count", "latest_report_risk_score",
    "active_report_count", "has_active_alert", "primary_region_home", "primary_region_work",
    "recent_cluster_distance_km", "hotspot_nearby", *[f"profile_{p}" for p in PROFILES],
]


def newest_clusters(t: Tables, keep: int = 5) -> DataFrame:
    """At most ``keep`` newest hotspots of each disease, as one short array per disease."""
    newest = Window.partitionBy("disease_id").orderBy(F.desc("generated_at"), F.desc("id"))
    top = t.geocluster.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= keep)
    return top.groupBy("disease_id").agg(
        F.collect_list(F.struct("center_lat", "center_long", "radius")).alias("spots")
    )


def visit_features(t: Tables, visits: DataFrame | None = None) -> DataFrame:
    """The 24 numeric features of each visit."""
    visits = t.visit if visits is None else visits
    patient = t.patient.select(F.col("id").alias("patient_id"), "birth_date")
    disease = t.disease.select(
        F.col("id").alias("disease_id"), "risk_level", "infection_score", "high_priority",
        "rare_disease", "policy_profile",
    )
    d = (
        visits.withColumnRenamed("id", "visit_id")
        .join(shuffled(points_by_visit(t)), "visit_id", "left")
        .join(shuffled(labs_by_visit(t, risk_abnormal)), "visit_id", "left")
        .join(shuffled(reports_by_visit(t)), "visit_id", "left")
        .join(shuffled(patient), "patient_id")
        .join(disease, "disease_id")
        .join(newest_clusters(t), "disease_id", "left")
    )
    lat, lon = F.col("point.latitude"), F.col("point.longitude")

    def away(s: Column) -> Column:
        return distance_km(lat, lon, s.center_lat, s.center_long)

    nearest = F.array_min(F.transform("spots", away))
    hit = F.exists("spots", lambda s: away(s) <= F.greatest(s.radius, F.lit(3.0)))
    known = lat.isNotNull() & F.col("spots").isNotNull()
    region = F.col("point.region_type")
    values = {
        "disease_risk_level": F.col("risk_level"),
        "disease_infection_score": F.col("infection_score"),
        "disease_high_priority": F.col("high_priority").cast("int"),
        "disease_rare": F.col("rare_disease").cast("int"),
        "patient_age_years": age_years(F.col("birth_date"), F.col("diagnosis_date")),
        "bmi": risk_bmi(F.col("weight"), F.col("height")),
        "geodata_count": F.col("geodata_count"),
        "has_home_geodata": F.col("has_home_geodata"),
        "has_work_geodata": F.col("has_work_geodata"),
        "total_lab_test_count": F.col("total_lab_test_count"),
        "abnormal_lab_test_count": F.col("abnormal_lab_test_count"),
        "latest_report_risk_score": F.col("latest.risk_score"),
        "active_report_count": F.col("active_report_count"),
        "has_active_alert": (F.col("active_report_count") > 0).cast("int"),
        "primary_region_home": (region == "home").cast("int"),
        "primary_region_work": (region == "work").cast("int"),
        "recent_cluster_distance_km": F.when(known, F.round(nearest, 4)),
        "hotspot_nearby": F.when(known, hit.cast("int")),
        **{f"profile_{p}": (F.col("policy_profile") == p).cast("int") for p in PROFILES},
    }
    return d.select(
        "visit_id",
        *[F.coalesce(values[f].cast("double"), F.lit(0.0)).alias(f) for f in FEATURES],
    )


def report_labels(t: Tables) -> DataFrame:
    """Most severe report level of each trigger visit."""
    position = F.array_position(F.array(*[F.lit(x) for x in LABELS]), F.col("alert_level"))
    worst = t.report.filter(F.col("trigger_visit_id").isNotNull()).groupBy(
        F.col("trigger_visit_id").alias("visit_id")
    ).agg(F.max(position).alias("worst"))
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), F.col("worst").cast("int"))
    return worst.filter("worst > 0").select("visit_id", label.alias("report_label"))


def visit_labels(t: Tables, visits: DataFrame) -> DataFrame:
    """Label and its source for each visit: report, else outbreak engine, else low."""
    labelled = visits.select(F.col("id").alias("visit_id")).join(shuffled(report_labels(t)), "visit_id", "left")
    open_ids = labelled.filter("report_label is null").select("visit_id")
    start = points_by_visit(t).select("visit_id", F.col("point.id").alias("id"))
    asked = start.join(shuffled(open_ids), "visit_id", "left_semi")
    points = t.geodata.join(shuffled(asked), ["visit_id", "id"], "left_semi")
    analyses = evaluate_outbreaks(t, contexts_of(t, points), alert_policies(t.disease))
    engine = analyses.select(
        "visit_id",
        F.when(F.col("alert_level").isin(LABELS), F.col("alert_level")).otherwise("low").alias("engine_label"),
    )
    source = (
        F.when(F.col("report_label").isNotNull(), "report")
        .when(F.col("engine_label").isNotNull(), "engine")
        .otherwise("default")
    )
    return labelled.join(shuffled(engine), "visit_id", "left").select(
        "visit_id", F.coalesce("report_label", "engine_label", F.lit("low")).alias("label"),
        source.alias("label_source"),
    )


def training_samples(t: Tables) -> DataFrame:
    """Features and labels of all globally active visits, which are worked out once for both."""
    visits = cut_lineage(active_visits(t.visit))
    return visit_features(t, visits).join(shuffled(visit_labels(t, visits)), "visit_id")


def _scaled(name: str) -> Column:
    low, high = F.col(f"bounds.min_{name}"), F.col(f"bounds.max_{name}")
    share = (F.col(name) - low) / F.nullif(high - low, F.lit(0.0))
    return F.coalesce(F.round(share, 6), F.lit(0.0))


def train_centroids(samples: DataFrame) -> DataFrame:
    """One artifact row per label: centroid, feature bounds and counts.

    Two aggregations over the stored samples: the bounds as a one-row scalar subquery, then the class
    means. The artifact is stored as well, because it is checked, saved and read apart.
    """
    samples = cut_lineage(samples)
    bounds = samples.agg(
        *[F.min(f).alias(f"min_{f}") for f in FEATURES], *[F.max(f).alias(f"max_{f}") for f in FEATURES]
    ).select(F.struct("*")).scalar()
    ranged = samples.withColumn("bounds", bounds)
    means = ranged.groupBy("label").agg(
        F.array(*[F.round(F.avg(_scaled(f)), 6) for f in FEATURES]).alias("centroid"),
        F.array(*[F.first(f"bounds.min_{f}") for f in FEATURES]).alias("feature_min"),
        F.array(*[F.first(f"bounds.max_{f}") for f in FEATURES]).alias("feature_max"),
        F.count(F.lit(1)).alias("label_count"),
        *[F.count_if(F.col("label_source") == s).alias(f"from_{s}") for s in ("report", "engine", "default")],
    )
    names = F.array(*[F.lit(f) for f in FEATURES])
    return cut_lineage(means.withColumn("feature_names", names))


def require_trainable(artifact: DataFrame) -> DataFrame:
    """Refuse fewer than two samples or two labels."""
    found = artifact.agg(F.count(F.lit(1)).alias("labels"), F.sum("label_count").alias("n")).first()
    if (found["n"] or 0) < 2:
        raise ValueError("training needs at least 2 samples")
    if found["labels"] < 2:
        raise ValueError("training needs at least 2 distinct labels")
    return artifact


def centroid_rows(artifact: DataFrame) -> DataFrame:
    """The artifact in long form: one row per (label, feature)."""
    zipped = F.arrays_zip("feature_names", "centroid", "feature_min", "feature_max")
    return artifact.select("label", "label_count", F.explode(zipped).alias("z")).select(
        "label", "label_count", F.col("z.feature_names").alias("feature"), "z.centroid",
        "z.feature_min", "z.feature_max",
    )


def predict_centroids(t: Tables, features: DataFrame, artifact: DataFrame) -> DataFrame:
    """Nearest centroid with inverse-distance confidence; inactive visits are low."""
    # At most one row per label, so the whole artifact fits a scalar subquery.
    model = artifact.agg(F.collect_list(F.struct("label", "centroid", "feature_min", "feature_max"))).scalar()
    d = features.withColumn("model", model)

    def distance(m: Column) -> Column:
        total = F.lit(0.0)
        for i, name in enumerate(FEATURES):
            low, high = m.feature_min[i], m.feature_max[i]
            share = F.coalesce(F.round((F.col(name) - low) / F.nullif(high - low, F.lit(0.0)), 6), F.lit(0.0))
            gap = share - m.centroid[i]
            total = total + gap * gap
        rank = F.array_position(F.array(*[F.lit(x) for x in LABELS]), m.label)
        return F.struct(F.round(F.sqrt(total), 6).alias("distance"), rank.alias("rank"), m.label.alias("label"))

    d = d.withColumn("scored", F.transform("model", distance))
    best = F.array_min("scored")
    pull = F.transform("scored", lambda s: F.lit(1.0) / (s.distance + 1e-6))
    whole = F.aggregate(pull, F.lit(0.0), lambda a, b: a + b)
    activity = flag_active(t.visit).select(F.col("id").alias("visit_id"), "is_active")
    d = d.withColumns({"best": best, "whole": whole}).join(activity, "visit_id").join(
        report_labels(t), "visit_id", "left"
    )
    on = F.col("is_active")
    return d.select(
        "visit_id",
        F.when(on, F.col("best.label")).otherwise("low").alias("predicted_label"),
        F.when(on, F.round(F.lit(1.0) / (F.col("best.distance") + 1e-6) / F.col("whole"), 4)).otherwise(1.0).alias("confidence"),
        F.when(on, F.map_from_entries(F.transform("scored", lambda s: F.struct(s.label, s.distance)))).alias("class_distances"),
        F.when(~on, "inactive_status").when(F.col("report_label").isNotNull(), "report").alias("label_source"),
    )
