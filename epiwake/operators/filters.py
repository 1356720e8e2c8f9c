"""Row filters, scopes and ordered lists."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epiwake.functions.clinical import is_active_report
from epiwake.operators.active import active_points, active_visits, apply_point_mode
from epiwake.tables import Tables

# Fixed value: the most rows that a caller may ask for in one page of the map feed.
MAP_LIMIT_MAX = 10000
PAGE_SIZE_DEFAULT, PAGE_SIZE_MAX = 100, 1000


def _all(df: DataFrame, tests: list[Column]) -> DataFrame:
    for test in tests:
        df = df.filter(test)
    return df


def filter_visits(
    visits: DataFrame,
    *,
    disease: int | None = None,
    doctor: int | None = None,
    patient: int | None = None,
    date_from: date | None = None,
    date_to: date | None = None,
) -> DataFrame:
    equal = {"disease_id": disease, "doctor_id": doctor, "patient_id": patient}
    tests = [F.col(name) == value for name, value in equal.items() if value is not None]
    if date_from:
        tests.append(F.col("diagnosis_date") >= F.lit(date_from))
    if date_to:
        tests.append(F.col("diagnosis_date") <= F.lit(date_to))
    return _all(visits, tests)


def filter_points(points: DataFrame, region: str | None = None) -> DataFrame:
    return points if region is None else points.filter(F.col("region_type") == region)


def in_hospital(df: DataFrame, doctors: DataFrame, hospital_id: int | None) -> DataFrame:
    """Rows whose ``doctor_id`` works in the hospital; no hospital means no rows."""
    if hospital_id is None:
        return df.filter(F.lit(False))
    staff = doctors.filter(F.col("hospital_id") == hospital_id)
    return df.join(staff.select(F.col("id").alias("doctor_id")), "doctor_id", "left_semi")


def visits_in_hospital(t: Tables, hospital_id: int | None) -> DataFrame:
    return in_hospital(t.visit, t.doctor, hospital_id)


def by_visit_in_hospital(child: DataFrame, t: Tables, hospital_id: int | None) -> DataFrame:
    """Scope any table that carries ``visit_id`` (points, lab tests)."""
    visits = visits_in_hospital(t, hospital_id).select(F.col("id").alias("visit_id"))
    return child.join(visits, "visit_id", "left_semi")


def doctors_in_hospital(t: Tables, hospital_id: int | None) -> DataFrame:
    if hospital_id is None:
        return t.doctor.filter(F.lit(False))
    return t.doctor.filter(F.col("hospital_id") == hospital_id)


def hospitals_visible(t: Tables, hospital_id: int | None) -> DataFrame:
    if hospital_id is None:
        return t.hospital.filter(F.lit(False))
    return t.hospital.filter(F.col("id") == hospital_id)


def patients_in_hospital(t: Tables, hospital_id: int | None) -> DataFrame:
    """Patients seen in the hospital, and patients nobody has seen yet."""
    if hospital_id is None:
        return t.patient.filter(F.lit(False))
    staff = t.doctor.select(
        F.col("id").alias("doctor_id"), (F.col("hospital_id") == hospital_id).alias("here")
    )
    seen = (
        t.visit.join(staff, "doctor_id", "left")
        .groupBy(F.col("patient_id").alias("id"))
        .agg(F.max(F.coalesce("here", F.lit(False))).alias("here"))
    )
    return t.patient.join(seen, "id", "left").filter(F.coalesce("here", F.lit(True))).drop("here")


@dataclass(frozen=True)
class MapFilter:
    disease_code: str | None = None
    disease_type: str | None = None
    start_date: date | None = None
    end_date: date | None = None
    region: str | None = None
    status: str | None = None
    #: Rows of a page; the whole feed without one.
    limit: int | None = None

    def __post_init__(self):
        if self.limit is not None and not 1 <= self.limit <= MAP_LIMIT_MAX:
            raise ValueError(f"limit lies between 1 and {MAP_LIMIT_MAX}")
        if self.start_date and self.end_date and self.start_date > self.end_date:
            raise ValueError("end_date lies before start_date")
        for value in (self.disease_code, self.disease_type):
            if value is not None and not value.strip():
                raise ValueError("a disease filter may not be blank")

    def tests(self) -> list[Column]:
        tests = []
        if self.disease_code:
            tests.append(F.upper("disease_code") == self.disease_code.strip().upper())
        if self.disease_type:
            tests.append(F.upper("disease_type") == self.disease_type.strip().upper())
        if self.start_date:
            tests.append(F.col("diagnosis_date") >= F.lit(self.start_date))
        if self.end_date:
            tests.append(F.col("diagnosis_date") <= F.lit(self.end_date))
        if self.region:
            tests.append(F.col("region_type") == self.region)
        if self.status:
            tests.append(F.col("status") == self.status)
        return tests


def map_case_columns(points: DataFrame, t: Tables) -> DataFrame:
    """Add disease and hospital columns and name everything as the map feed does."""
    disease = t.disease.select(
        F.col("id").alias("disease_id"), "disease_code",
        F.col("name").alias("disease_name"), F.col("type").alias("disease_type"),
    )
    doctor = t.doctor.select(
        F.col("id").alias("doctor_id"), F.col("hospital_id").alias("doctor_hospital_id")
    )
    return points.join(disease, "disease_id").join(doctor, "doctor_id").select(
        F.col("id").alias("geodata_id"), "visit_id", "patient_id", "disease_id", "disease_code",
        "disease_name", "disease_type", "doctor_id", "doctor_hospital_id", "diagnosis_date",
        "status", "region_type", "latitude", "longitude",
    )


def map_cases(
    t: Tables,
    filters: MapFilter = MapFilter(),
    hospital_id: int | None = None,
    active: bool = True,
) -> DataFrame:
    """The active or historical map feed: all of it, or the oldest cases up to a limit the caller sets."""
    if active:
        points = active_points(t)
    else:
        visits = t.visit.select(
            F.col("id").alias("visit_id"), "disease_id", "diagnosis_date", "doctor_id", "status"
        )
        points = t.geodata.join(visits, "visit_id")
    cases = _all(map_case_columns(points, t), filters.tests())
    if hospital_id is not None:
        cases = cases.filter(F.col("doctor_hospital_id") == hospital_id)
    if filters.limit is None:
        return cases
    return cases.orderBy("diagnosis_date", "geodata_id").limit(filters.limit)


def active_point_list(t: Tables, *, region=None, mode=None, hospital_id=None, **visit_filter) -> DataFrame:
    """Points of globally active visits under the visit, region and hospital filters."""
    points = filter_points(active_points(t), region)
    points = filter_visits(points, **visit_filter)
    if hospital_id is not None:
        points = in_hospital(points, t.doctor, hospital_id)
    return apply_point_mode(points, mode).orderBy("diagnosis_date", "id")


def alerts_in_force(t: Tables) -> DataFrame:
    """Open alerts of level medium or above whose trigger visit, if any, is still active."""
    reports = t.report.filter(is_active_report(F.col("status"), F.col("alert_level")))
    active = active_visits(t.visit).select(F.col("id").alias("trigger_visit_id"))
    standing = reports.join(active.withColumn("_on", F.lit(True)), "trigger_visit_id", "left")
    return standing.filter(F.col("trigger_visit_id").isNull() | F.col("_on")).drop("_on")


def active_alerts(
    t: Tables, *, disease=None, level=None, status=None, min_risk=None, limit=None
) -> DataFrame:
    alerts = alerts_in_force(t)
    equal = {"disease_id": disease, "alert_level": level, "status": status}
    tests = [F.col(name) == value for name, value in equal.items() if value is not None]
    if min_risk is not None:
        tests.append(F.col("risk_score") >= min_risk)
    ordered = _all(alerts, tests).orderBy(F.desc("risk_score"), F.desc("generated_at"), F.desc("id"))
    return ordered.limit(limit) if limit and limit > 0 else ordered


def active_hotspots(
    t: Tables, *, disease=None, min_risk_level=None, min_case_count=None, limit=None
) -> DataFrame:
    tests = [F.col("risk_level") >= 2]
    if disease is not None:
        tests.append(F.col("disease_id") == disease)
    if min_risk_level is not None:
        tests.append(F.col("risk_level") >= min_risk_level)
    if min_case_count is not None:
        tests.append(F.col("case_count") >= min_case_count)
    ordered = _all(t.geocluster, tests).orderBy(
        F.desc("risk_level"), F.desc("case_count"), F.desc("generated_at"), F.desc("id")
    )
    return ordered.limit(limit) if limit and limit > 0 else ordered


def page(ordered: DataFrame, number: int = 1, size: int = PAGE_SIZE_DEFAULT) -> DataFrame:
    size = max(1, min(size, PAGE_SIZE_MAX))
    return ordered.offset((number - 1) * size).limit(size)


def newest_visits_first(visits: DataFrame) -> DataFrame:
    return visits.orderBy(F.desc("diagnosis_date"), F.desc("id"))


def newest_lab_tests_first(lab_tests: DataFrame) -> DataFrame:
    return lab_tests.orderBy(F.desc("test_date"), F.desc("id"))


def hospitals_by_name(hospitals: DataFrame) -> DataFrame:
    return hospitals.orderBy("name", "id")


def patient_history(t: Tables, patient_id: int | None = None, hospital_id: int | None = None) -> DataFrame:
    """Visits with the doctor and hospital columns of the visit record, newest first."""
    visits = filter_visits(t.visit, patient=patient_id)
    if hospital_id is not None:
        visits = in_hospital(visits, t.doctor, hospital_id)
    doctor = t.doctor.select(F.col("id").alias("doctor_id"), "user_id", "specialization", "hospital_id")
    users = t.users.select(F.col("id").alias("user_id"), "username", "real_name")
    hospital = t.hospital.select(F.col("id").alias("hospital_id"), F.col("name").alias("hospital_name"))
    joined = visits.join(doctor, "doctor_id").join(users, "user_id").join(hospital, "hospital_id")
    return newest_visits_first(joined).select(
        "id", "patient_id", "disease_id", "diagnosis_date", "status", "doctor_id", "username",
        "real_name", "specialization", "hospital_id", "hospital_name",
    )
