"""The table bundle every operator takes, with the declared schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "users": "id long, username string, email string, first_name string, last_name string, "
    "real_name string, phon_number string, role string, is_active boolean, "
    "email_verified boolean, admin_approved boolean",
    "hospital": "id long, name string, hospital_lat double, hospital_long double, "
    "location string, city string",
    "doctor": "id long, user_id long, specialization string, hospital_id long",
    "patient": "id long, national_number string, name string, birth_date date, gender string, "
    "residence_lat double, residence_long double, work_lat double, work_long double",
    "disease": "id long, disease_code string, name string, type string, "
    "transmission_vector string, symptoms string, risk_level int, infection_score double, "
    "source_record_id int, source_name string, is_reference boolean, policy_profile string, "
    "high_priority boolean, rare_disease boolean",
    "visit": "id long, patient_id long, doctor_id long, disease_id long, diagnose string, "
    "diagnosis_date date, status string, weight double, height double, marital_status string",
    "geodata": "id long, patient_id long, visit_id long, latitude double, longitude double, "
    "region_type string",
    "geocluster": "id long, center_lat double, center_long double, radius double, "
    "disease_id long, case_count int, risk_level int, generated_at timestamp",
    "report": "id long, generated_at timestamp, disease_id long, trigger_visit_id long, "
    "analysis_period_start date, analysis_period_end date, alert_level string, summary string, "
    "risk_score double, nearby_case_count int, current_case_count int, previous_case_count int, "
    "growth_rate double, surge_ratio double, reasons array<string>, status string",
    "lab_test": "id long, visit_id long, test_code string, test_name string, result string, "
    "test_date timestamp, notes string",
    "medical_history": "id long, patient_id long, has_surgical_metal_plates boolean",
    "vaccine": "id long, history_id long, vaccine_name string, date_administered date",
    "allergy": "id long, history_id long, allergy_name string, severity_level string",
    "chronic_disease": "id long, history_id long, disease_name string, diagnosis_date date",
    "surgical_history": "id long, history_id long, surgery_description string, "
    "surgery_date date, has_metal_plates boolean",
}


@dataclass(frozen=True)
class Tables:
    """DataFrames by table name; a job touches only the ones it needs."""

    visit: DataFrame
    disease: DataFrame
    geodata: DataFrame | None = None
    patient: DataFrame | None = None
    doctor: DataFrame | None = None
    hospital: DataFrame | None = None
    users: DataFrame | None = None
    report: DataFrame | None = None
    geocluster: DataFrame | None = None
    lab_test: DataFrame | None = None
    medical_history: DataFrame | None = None


def read_tables(spark: SparkSession, base: str) -> Tables:
    """Open the stored tables with their declared schemas (no inference)."""
    names = Tables.__dataclass_fields__
    return Tables(**{n: spark.read.schema(SCHEMAS[n]).parquet(f"{base}/{n}") for n in names})
