"""Plain aggregates, dashboard figures and on-demand reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiwake.operators.active import active_visits
from epiwake.operators.filters import alerts_in_force
from epiwake.tables import Tables


def cases_by_disease(t: Tables, visits: DataFrame | None = None) -> DataFrame:
    counts = (t.visit if visits is None else visits).groupBy("disease_id").agg(
        F.count(F.lit(1)).alias("total_cases")
    )
    names = t.disease.select(F.col("id").alias("disease_id"), F.col("name").alias("disease_name"))
    return counts.join(names, "disease_id").select(
        "disease_id", "disease_name", "total_cases"
    ).orderBy(F.desc("total_cases"), "disease_id")


def cases_over_time(t: Tables, visits: DataFrame | None = None) -> DataFrame:
    return (t.visit if visits is None else visits).groupBy("diagnosis_date").agg(
        F.count(F.lit(1)).alias("total_cases")
    ).orderBy("diagnosis_date")


def cases_by_doctor(t: Tables, visits: DataFrame | None = None) -> DataFrame:
    counts = (t.visit if visits is None else visits).groupBy("doctor_id").agg(
        F.count(F.lit(1)).alias("total_cases")
    )
    doctor = t.doctor.select(F.col("id").alias("doctor_id"), "user_id")
    users = t.users.select(F.col("id").alias("user_id"), F.col("username").alias("doctor_username"))
    return counts.join(doctor, "doctor_id").join(users, "user_id").select(
        "doctor_id", "doctor_username", "total_cases"
    ).orderBy(F.desc("total_cases"), "doctor_id")


def _points_of(t: Tables, visits: DataFrame | None, region: str | None) -> DataFrame:
    points = t.geodata if region is None else t.geodata.filter(F.col("region_type") == region)
    if visits is None:
        return points
    return points.join(visits.select(F.col("id").alias("visit_id")), "visit_id", "left_semi")


def cases_by_region_type(t: Tables, visits: DataFrame | None = None, region: str | None = None) -> DataFrame:
    # distinct before count: the pair (region, visit) spreads a hot region over all tasks.
    pairs = _points_of(t, visits, region).select("region_type", "visit_id").distinct()
    return pairs.groupBy("region_type").agg(F.count(F.lit(1)).alias("total_cases")).orderBy(
        F.desc("total_cases"), "region_type"
    )


def disease_region_matrix(t: Tables, visits: DataFrame | None = None, region: str | None = None) -> DataFrame:
    pairs = _points_of(t, None, region).select("region_type", "visit_id").distinct()
    chosen = (t.visit if visits is None else visits).select(
        F.col("id").alias("visit_id"), "disease_id"
    )
    names = t.disease.select(F.col("id").alias("disease_id"), F.col("name").alias("disease_name"))
    counts = pairs.join(chosen, "visit_id").groupBy("disease_id", "region_type").agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.join(names, "disease_id").groupBy("disease_name", "region_type").agg(
        F.sum("n").alias("total_cases")
    ).orderBy(F.desc("total_cases"), "disease_name", "region_type")


def alerts_by_disease(t: Tables, disease: int | None = None) -> DataFrame:
    alerts = alerts_in_force(t)
    if disease is not None:
        alerts = alerts.filter(F.col("disease_id") == disease)
    counts = alerts.groupBy("disease_id").agg(
        F.count(F.lit(1)).alias("alert_count"), F.max("risk_score").alias("max_risk_score")
    )
    names = t.disease.select(
        F.col("id").alias("disease_id"), F.col("name").alias("disease_name"), "disease_code"
    )
    return counts.join(names, "disease_id").select(
        "disease_id", "disease_name", "disease_code", "alert_count", "max_risk_score"
    ).orderBy(F.desc("alert_count"), F.desc("max_risk_score"))


def dashboard_summary(t: Tables, disease: int | None = None) -> DataFrame:
    """One row: alert, hotspot and case counts with the leading alert and hotspot."""
    alerts, hotspots = alerts_in_force(t), t.geocluster.filter(F.col("risk_level") >= 2)
    cases = active_visits(t.visit)
    if disease is not None:
        alerts, hotspots, cases = (
            df.filter(F.col("disease_id") == disease) for df in (alerts, hotspots, cases)
        )
    level, status = F.col("alert_level"), F.col("status")
    figures = alerts.agg(
        F.count(F.lit(1)).alias("active_alert_count"),
        *[F.count_if(level == x).alias(f"{x}_alert_count") for x in ("critical", "high", "medium")],
        *[F.count_if(status == x).alias(f"{x}_alert_count") for x in ("new", "reviewed")],
        F.max(F.struct("risk_score", "generated_at", "id")).alias("top_alert"),
    )
    spots = hotspots.agg(
        F.count(F.lit(1)).alias("active_hotspot_count"),
        F.max(F.struct("risk_level", "case_count", "generated_at", "id")).alias("top_hotspot"),
    ).select(F.struct("*")).scalar()
    case_count = cases.agg(F.count(F.lit(1))).scalar()
    return figures.withColumn("spots", spots).select(
        "active_alert_count", "critical_alert_count", "high_alert_count", "medium_alert_count",
        "new_alert_count", "reviewed_alert_count",
        F.col("spots.active_hotspot_count").alias("active_hotspot_count"),
        case_count.alias("active_case_count"),
        F.col("top_alert.id").alias("top_alert_id"),
        F.col("top_alert.risk_score").alias("top_alert_risk_score"),
        F.col("spots.top_hotspot.id").alias("top_hotspot_id"),
        F.col("spots.top_hotspot.risk_level").alias("top_hotspot_risk_level"),
    )
