"""On-demand outbreak reports for one disease or for all of them at once."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiwake.functions.clinical import report_alert_level
from epiwake.operators.trend import trend
from epiwake.tables import Tables


def generate_reports(
    t: Tables,
    *,
    disease_id: int | None = None,
    date_from: date | None = None,
    date_to: date | None = None,
    region: str | None = None,
) -> DataFrame:
    """A report row per disease that has visits under the filters."""
    visits = t.visit
    if disease_id is not None:
        visits = visits.filter(F.col("disease_id") == disease_id)
    if date_from:
        visits = visits.filter(F.col("diagnosis_date") >= F.lit(date_from))
    if date_to:
        visits = visits.filter(F.col("diagnosis_date") <= F.lit(date_to))
    if region is not None:
        located = t.geodata.filter(F.col("region_type") == region).select(F.col("visit_id").alias("id"))
        visits = visits.join(located, "id", "left_semi")
    start = F.lit(date_from) if date_from else F.min("diagnosis_date")
    end = F.lit(date_to) if date_to else F.max("diagnosis_date")
    periods = visits.groupBy("disease_id").agg(
        F.max(start).alias("current_start") if date_from else start.alias("current_start"),
        F.max(end).alias("current_end") if date_to else end.alias("current_end"),
    )
    days = F.greatest(F.date_diff("current_end", "current_start"), F.lit(1))
    windows = periods.withColumn("previous_end", F.date_sub("current_start", 1)).withColumn(
        "previous_start", F.date_sub(F.col("previous_end"), days)
    )
    disease = t.disease.select(
        F.col("id").alias("disease_id"), F.col("name").alias("disease_name"), "infection_score", "risk_level"
    )
    d = trend(t, windows, region).join(disease, "disease_id")
    cases, surge, growth = F.col("current_count"), F.col("surge_ratio"), F.col("growth_rate")
    risk = cases * F.col("infection_score") * F.col("risk_level")
    d = d.withColumn("risk_score", risk).withColumn(
        "alert_level", report_alert_level(F.col("risk_score"), cases, surge)
    )
    # Wording of the reasons and the summary.
    reasons = F.array_compact(
        F.array(
            F.format_string("Report generated for disease %s.", "disease_name"),
            F.format_string("Current period captured %d case(s).", cases),
            F.lit(None if region is None else f"Region type filter applied: {region}."),
            F.when((F.col("previous_count") == 0) & (cases > 0), "Current period has no previous baseline cases.")
            .when(surge >= 1.5, F.format_string("Temporal surge ratio reached %s.", surge.cast("string")))
            .when(growth > 0, F.format_string("Growth rate reached %s.", growth.cast("string"))),
        )
    )
    summary = F.format_string(
        "Disease %s recorded %d case(s) between %s and %s with alert level %s.",
        F.col("disease_name"), cases, F.col("current_start").cast("string"),
        F.col("current_end").cast("string"), F.col("alert_level"),
    )
    return d.select(
        "disease_id", F.lit(None).cast("long").alias("trigger_visit_id"),
        F.col("current_start").alias("analysis_period_start"),
        F.col("current_end").alias("analysis_period_end"), "alert_level", "risk_score",
        F.lit(0).alias("nearby_case_count"), cases.alias("current_case_count"),
        F.col("previous_count").alias("previous_case_count"), "growth_rate", "surge_ratio",
        summary.alias("summary"), reasons.alias("reasons"), F.lit("new").alias("status"),
    )
