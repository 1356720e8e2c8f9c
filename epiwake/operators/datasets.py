"""Training datasets per visit and per (disease, region, day)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epiwake.functions.clinical import (
    age_years, export_abnormal, export_bmi, is_active_report, preferred_point_order,
)
from epiwake.tables import Tables

# Column order of the two files.
VISIT_COLUMNS = [
    "visit_id", "diagnosis_date", "patient_id", "patient_gender", "patient_age_years", "doctor_id",
    "hospital_id", "hospital_city", "disease_id", "disease_code", "disease_name", "disease_type",
    "policy_profile", "disease_risk_level", "disease_infection_score", "disease_high_priority",
    "disease_rare", "visit_status", "marital_status", "weight", "height", "bmi",
    "primary_region_type", "primary_latitude", "primary_longitude", "geodata_count",
    "has_home_geodata", "has_work_geodata", "available_region_types", "total_lab_test_count",
    "abnormal_lab_test_count", "latest_report_alert_level", "latest_report_status",
    "latest_report_risk_score", "active_report_count", "has_active_alert",
]
REGION_DAY_COLUMNS = [
    "diagnosis_date", "disease_id", "disease_code", "disease_name", "disease_type",
    "policy_profile", "disease_high_priority", "disease_rare", "region_type", "visit_count",
    "unique_patient_count", "doctor_count", "hospital_count", "avg_latitude", "avg_longitude",
    "total_lab_test_count", "abnormal_lab_test_count", "active_report_count",
    "critical_alert_count", "high_alert_count", "medium_alert_count", "max_report_risk_score",
    "active_hotspot_count",
]


def disease_columns(t: Tables) -> DataFrame:
    return t.disease.select(
        F.col("id").alias("disease_id"), "disease_code", F.col("name").alias("disease_name"),
        F.col("type").alias("disease_type"), "policy_profile",
        F.col("risk_level").alias("disease_risk_level"),
        F.col("infection_score").alias("disease_infection_score"),
        F.col("high_priority").cast("int").alias("disease_high_priority"),
        F.col("rare_disease").cast("int").alias("disease_rare"),
    )


def points_by_visit(t: Tables) -> DataFrame:
    """Per visit: the preferred point and what regions it has points in."""
    home, work = (F.max((F.col("region_type") == r).cast("int")) for r in ("home", "work"))
    # min over a struct whose leading fields are the preference order carries the point along.
    first = F.min(
        F.struct(
            preferred_point_order(F.col("region_type"), F.col("id")).alias("order"),
            "region_type", "latitude", "longitude", "id",
        )
    )
    return t.geodata.groupBy("visit_id").agg(
        first.alias("point"), F.count(F.lit(1)).alias("geodata_count"),
        home.alias("has_home_geodata"), work.alias("has_work_geodata"),
        F.array_join(F.sort_array(F.collect_set("region_type")), ",").alias("available_region_types"),
    )


def labs_by_visit(t: Tables, abnormal) -> DataFrame:
    return t.lab_test.groupBy("visit_id").agg(
        F.count(F.lit(1)).alias("total_lab_test_count"),
        F.count_if(abnormal(F.col("result"))).alias("abnormal_lab_test_count"),
    )


def reports_by_visit(t: Tables) -> DataFrame:
    """Per trigger visit: its latest report and how many of its reports are active."""
    active = is_active_report(F.col("status"), F.col("alert_level"))
    latest = F.max(F.struct("generated_at", "id", "alert_level", "status", "risk_score"))
    return t.report.filter("trigger_visit_id is not null").groupBy(
        F.col("trigger_visit_id").alias("visit_id")
    ).agg(latest.alias("latest"), F.count_if(active).alias("active_report_count"))


def visit_level(t: Tables) -> DataFrame:
    doctor = t.doctor.select(F.col("id").alias("doctor_id"), "hospital_id")
    hospital = t.hospital.select(F.col("id").alias("hospital_id"), F.col("city").alias("hospital_city"))
    patient = t.patient.select(F.col("id").alias("patient_id"), F.col("gender").alias("patient_gender"), "birth_date")
    visits = t.visit.withColumnRenamed("id", "visit_id").withColumnRenamed("status", "visit_status")
    joined = (
        visits.join(points_by_visit(t), "visit_id", "left")
        .join(labs_by_visit(t, export_abnormal), "visit_id", "left")
        .join(reports_by_visit(t), "visit_id", "left")
        .join(patient, "patient_id")
        .join(doctor, "doctor_id")
        .join(hospital, "hospital_id")
        .join(disease_columns(t), "disease_id")
    )
    counts = ["geodata_count", "total_lab_test_count", "abnormal_lab_test_count", "active_report_count",
              "has_home_geodata", "has_work_geodata"]
    filled = joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts})
    return filled.withColumns(
        {
            "patient_age_years": age_years(F.col("birth_date"), F.col("diagnosis_date")),
            "bmi": export_bmi(F.col("weight"), F.col("height")),
            "primary_region_type": F.col("point.region_type"),
            "primary_latitude": F.round("point.latitude", 4),
            "primary_longitude": F.round("point.longitude", 4),
            "available_region_types": F.coalesce("available_region_types", F.lit("")),
            "latest_report_alert_level": F.col("latest.alert_level"),
            "latest_report_status": F.col("latest.status"),
            "latest_report_risk_score": F.col("latest.risk_score"),
            "has_active_alert": (F.col("active_report_count") > 0).cast("int"),
        }
    ).select(*VISIT_COLUMNS)


def report_days(t: Tables) -> DataFrame:
    """Active reports in force on each (disease, day).

    Equal periods collapse before they are spelled out as days, which turns the interval
    join with the visits into a plain hash join on (disease, day).
    """
    level = F.col("alert_level")
    periods = (
        t.report.filter(is_active_report(F.col("status"), level))
        .filter("analysis_period_start <= analysis_period_end")
        .groupBy("disease_id", "analysis_period_start", "analysis_period_end")
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.count_if(level == x).alias(x) for x in ("critical", "high", "medium")],
            F.max("risk_score").alias("risk"),
        )
    )
    days = F.explode(F.sequence("analysis_period_start", "analysis_period_end"))
    return (
        periods.select("disease_id", days.alias("diagnosis_date"), "n", "critical", "high", "medium", "risk")
        .groupBy("disease_id", "diagnosis_date")
        .agg(*[F.sum(c).alias(c) for c in ("n", "critical", "high", "medium")], F.max("risk").alias("risk"))
    )


def disease_region_day(t: Tables) -> DataFrame:
    key = ["diagnosis_date", "disease_id", "region_type"]
    places = t.geodata.groupBy("visit_id", "region_type").agg(
        F.count(F.lit(1)).alias("points"), F.sum("latitude").alias("lat"), F.sum("longitude").alias("lon")
    )
    visits = t.visit.select(F.col("id").alias("visit_id"), "patient_id", "doctor_id", "disease_id", "diagnosis_date")
    doctor = t.doctor.select(F.col("id").alias("doctor_id"), "hospital_id")
    rows = (
        visits.join(labs_by_visit(t, export_abnormal), "visit_id", "left")
        .join(places, "visit_id", "left")
        .join(doctor, "doctor_id")
        .withColumn("region_type", F.coalesce("region_type", F.lit("unknown")))
    )
    groups = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("visit_count"),
        F.count_distinct("patient_id").alias("unique_patient_count"),
        F.count_distinct("doctor_id").alias("doctor_count"),
        F.count_distinct("hospital_id").alias("hospital_count"),
        F.sum("points").alias("points"), F.sum("lat").alias("lat"), F.sum("lon").alias("lon"),
        F.coalesce(F.sum("total_lab_test_count"), F.lit(0)).alias("total_lab_test_count"),
        F.coalesce(F.sum("abnormal_lab_test_count"), F.lit(0)).alias("abnormal_lab_test_count"),
    )
    hotspots = t.geocluster.filter("risk_level >= 2").groupBy("disease_id").agg(
        F.count(F.lit(1)).alias("active_hotspot_count")
    )
    n = F.col("visit_count")
    zero = F.lit(0).cast("long")
    return (
        groups.join(report_days(t), ["disease_id", "diagnosis_date"], "left")
        .join(hotspots, "disease_id", "left")
        .join(disease_columns(t), "disease_id")
        .withColumns(
            {
                "avg_latitude": F.round(F.col("lat") / F.col("points"), 4),
                "avg_longitude": F.round(F.col("lon") / F.col("points"), 4),
                "active_report_count": n * F.coalesce("n", zero),
                "critical_alert_count": n * F.coalesce("critical", zero),
                "high_alert_count": n * F.coalesce("high", zero),
                "medium_alert_count": n * F.coalesce("medium", zero),
                "max_report_risk_score": F.greatest(F.coalesce("risk", F.lit(0.0)), F.lit(0.0)),
                "active_hotspot_count": F.coalesce("active_hotspot_count", zero),
            }
        )
        .select(*REGION_DAY_COLUMNS)
    )
