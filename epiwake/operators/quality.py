"""Constraint checks as a job that lists the violations of every row."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epiwake.tables import Tables

# The domains of the coded columns.
DOMAINS = {
    "role": ["admin", "doctor"],
    "gender": ["male", "female"],
    "visit_status": ["infected", "cured"],
    "marital_status": ["divorced", "single", "married", "widow"],
    "region_type": ["home", "work"],
    "policy_profile": [
        "general", "high_priority", "rare", "cluster_sensitive", "surge_sensitive",
        "environmental_signal",
    ],
    "alert_level": ["low", "medium", "high", "critical"],
    "report_status": ["new", "reviewed", "resolved", "archived"],
}


def _outside(col: str, low: float, high: float) -> Column:
    value = F.col(col)
    return value.isNotNull() & ((value < low) | (value > high) | F.isnan(value.cast("double")))


def _not_in(col: str, domain: str) -> Column:
    return ~F.coalesce(F.col(col).isin(DOMAINS[domain]), F.lit(False))


def _negative(col: str) -> Column:
    return F.col(col) < 0


def _blank(col: str) -> Column:
    return F.trim(F.coalesce(F.col(col), F.lit(""))) == ""


def _unpaired(a: str, b: str) -> Column:
    return F.col(a).isNull() != F.col(b).isNull()


def _with(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    found = [F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()]
    return df.withColumn("violations", F.array_compact(F.array(*found)))


def check_users(users: DataFrame) -> DataFrame:
    return _with(users, {"role": _not_in("role", "role")})


def check_hospitals(hospitals: DataFrame) -> DataFrame:
    rules = {"hospital_lat": _outside("hospital_lat", -90, 90), "hospital_long": _outside("hospital_long", -180, 180)}
    return _with(hospitals, rules)


def check_patients(patients: DataFrame, today: date) -> DataFrame:
    rules = {
        "gender": _not_in("gender", "gender"),
        "residence_lat": _outside("residence_lat", -90, 90),
        "residence_long": _outside("residence_long", -180, 180),
        "work_lat": _outside("work_lat", -90, 90),
        "work_long": _outside("work_long", -180, 180),
        "residence_pair": _unpaired("residence_lat", "residence_long"),
        "work_pair": _unpaired("work_lat", "work_long"),
        "birth_date": F.col("birth_date") > F.lit(today),
        "name": _blank("name"),
        "national_number": _blank("national_number"),
    }
    return _with(patients, rules)


def check_diseases(diseases: DataFrame) -> DataFrame:
    rules = {
        "risk_level": _outside("risk_level", 0, 5),
        "infection_score": _negative("infection_score"),
        "policy_profile": _not_in("policy_profile", "policy_profile"),
        "disease_code": _blank("disease_code"),
        "code_not_upper": F.col("disease_code") != F.upper(F.trim("disease_code")),
        "name": _blank("name"),
    }
    return _with(diseases, rules)


def check_visits(t: Tables) -> DataFrame:
    born = t.patient.select(F.col("id").alias("patient_id"), "birth_date")
    rules = {
        "status": _not_in("status", "visit_status"),
        "marital_status": _not_in("marital_status", "marital_status"),
        "weight": _outside("weight", 0.1, 500),
        "height": _outside("height", 30, 250),
        "before_birth": F.col("diagnosis_date") < F.col("birth_date"),
    }
    return _with(t.visit.join(born, "patient_id", "left"), rules).drop("birth_date")


def check_points(t: Tables) -> DataFrame:
    owner = t.visit.select(F.col("id").alias("visit_id"), F.col("patient_id").alias("visit_patient"))
    rules = {
        "region_type": _not_in("region_type", "region_type"),
        "latitude": F.col("latitude").isNull() | _outside("latitude", -90, 90),
        "longitude": F.col("longitude").isNull() | _outside("longitude", -180, 180),
        "patient": F.col("patient_id") != F.col("visit_patient"),
    }
    return _with(t.geodata.join(owner, "visit_id", "left"), rules).drop("visit_patient")


def check_clusters(clusters: DataFrame) -> DataFrame:
    rules = {
        "center_lat": F.col("center_lat").isNull() | _outside("center_lat", -90, 90),
        "center_long": F.col("center_long").isNull() | _outside("center_long", -180, 180),
        "radius": _negative("radius"),
        "case_count": _negative("case_count"),
        "risk_level": _outside("risk_level", 0, 5),
    }
    return _with(clusters, rules)


def check_reports(t: Tables) -> DataFrame:
    trigger = t.visit.select(F.col("id").alias("trigger_visit_id"), F.col("disease_id").alias("trigger_disease"))
    rules = {
        "alert_level": _not_in("alert_level", "alert_level"),
        "status": _not_in("status", "report_status"),
        "period": F.col("analysis_period_start") > F.col("analysis_period_end"),
        "trigger_visit": F.col("trigger_disease") != F.col("disease_id"),
        **{n: _negative(n) for n in ("nearby_case_count", "current_case_count", "previous_case_count")},
    }
    return _with(t.report.join(trigger, "trigger_visit_id", "left"), rules).drop("trigger_disease")


def repeated_keys(df: DataFrame, key: Column, name: str) -> DataFrame:
    """Key values that occur more than once although they should be unique."""
    return (
        df.select(key.cast("string").alias("key_value"))
        .filter(F.col("key_value").isNotNull())
        .groupBy("key_value")
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .filter("occurrences > 1")
        .select(F.lit(name).alias("rule"), "key_value", "occurrences")
    )


def duplicates(t: Tables, diseases: DataFrame | None = None) -> DataFrame:
    parts = [
        repeated_keys(t.disease if diseases is None else diseases, F.col("disease_code"), "disease_code"),
        repeated_keys(t.patient, F.col("national_number"), "national_number"),
        repeated_keys(t.users, F.nullif(F.lower("email"), F.lit("")), "email"),
    ]
    if t.medical_history is not None:
        parts.append(repeated_keys(t.medical_history, F.col("patient_id"), "patient_history"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def summarise(checked: dict[str, DataFrame]) -> DataFrame:
    """Violation counts by table and rule."""
    out = None
    for table, df in checked.items():
        part = df.select(F.lit(table).alias("table_name"), F.explode("violations").alias("rule"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("table_name", "rule").agg(F.count(F.lit(1)).alias("violations"))


def check_all(t: Tables, today: date) -> dict[str, DataFrame]:
    return {
        "users": check_users(t.users),
        "hospital": check_hospitals(t.hospital),
        "patient": check_patients(t.patient, today),
        "disease": check_diseases(t.disease),
        "visit": check_visits(t),
        "geodata": check_points(t),
        "geocluster": check_clusters(t.geocluster),
        "report": check_reports(t),
    }
