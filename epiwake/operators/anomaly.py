"""Daily anomaly candidates per (disease, region) against a rolling baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epiwake.operators.active import active_points, date_window
from epiwake.tables import Tables

SERIES = ["disease_id", "region_type"]


def daily_series(t: Tables, within: Column | None, region: str | None = None) -> DataFrame:
    """Distinct active visits per (disease, region, date); latest chosen inside the window."""
    points = active_points(t, within=within, region=region)
    # (region, visit) pairs first: no single task ever holds a hot day's visits.
    visits = points.select(*SERIES, "diagnosis_date", "visit_id").distinct()
    return visits.groupBy(*SERIES, "diagnosis_date").agg(F.count(F.lit(1)).alias("cases"))


def fill_days(series: DataFrame) -> DataFrame:
    """Add the missing days between each series' own first and last date with a zero count."""
    span = series.groupBy(*SERIES).agg(
        F.min("diagnosis_date").alias("first"), F.max("diagnosis_date").alias("last")
    )
    spine = span.select(*SERIES, F.explode(F.sequence("first", "last")).alias("diagnosis_date"))
    return spine.join(series, [*SERIES, "diagnosis_date"], "left").select(
        *SERIES, "diagnosis_date", F.coalesce("cases", F.lit(0).cast("long")).alias("cases")
    )


def _median(values: Column, size: int) -> Column:
    ordered = F.sort_array(values)
    low, high = ordered[(size - 1) // 2], ordered[size // 2]
    return (low + high).cast("double") / 2


def detect_anomalies(
    t: Tables,
    *,
    disease_id: int | None = None,
    lookback_days: int = 30,
    baseline_window_days: int = 7,
    region: str | None = None,
) -> DataFrame:
    if lookback_days < 2 or baseline_window_days < 2:
        raise ValueError("lookback_days and baseline_window_days must be at least 2")
    n = baseline_window_days
    within = date_window(t, disease_id, lookback_days)
    dense = fill_days(daily_series(t, within, region))

    ordered = Window.partitionBy(*SERIES).orderBy("diagnosis_date")
    before = ordered.rowsBetween(-n, -1)
    scored = dense.select(
        "*",
        F.row_number().over(ordered).alias("position"),
        F.collect_list("cases").over(before).alias("baseline"),
        F.avg("cases").over(before).alias("mean"),
        F.max("cases").over(before).alias("highest"),
    ).filter((F.col("position") > n) & (F.col("cases") > 0))

    observed, mean = F.col("cases"), F.col("mean")
    scored = scored.withColumn("median", _median(F.col("baseline"), n))
    gaps = F.transform("baseline", lambda v: F.abs(v - F.col("median")))
    scored = scored.withColumn("mad", _median(gaps, n))
    above = observed - F.col("median")
    spread = F.nullif(F.col("mad"), F.lit(0.0))
    deviation = F.greatest(F.coalesce(F.lit(0.6745) * above / spread, above), F.lit(0.0))
    ratio = F.coalesce(F.round(observed / F.nullif(mean, F.lit(0.0)), 2), observed.cast("double"))

    disease = t.disease.select(
        F.col("id").alias("disease_id"), "disease_code", F.col("name").alias("disease_name"),
        "policy_profile", "high_priority", "rare_disease",
    )
    scored = scored.withColumns({"surge": ratio, "deviation": F.round(deviation, 2)}).join(
        disease, "disease_id"
    )
    rare, priority = F.col("rare_disease"), F.col("high_priority")
    surge, dev = F.col("surge"), F.col("deviation")
    sensitive = F.col("policy_profile").isin("cluster_sensitive", "surge_sensitive")
    minimum = F.when(rare, 1).when(priority | sensitive, 2).otherwise(3)
    volume = F.when((mean == 0) & (observed >= minimum), F.least(observed * 10, F.lit(35)).cast("double")).otherwise(
        F.least(F.greatest(observed - mean, F.lit(0.0)) * 12, F.lit(35.0))
    )
    total = (
        volume
        + F.when(surge >= 2.0, F.least((surge - 1.0) * 18, F.lit(25.0))).otherwise(0.0)
        + F.when(dev >= 2.0, F.least(dev * 6, F.lit(20.0))).otherwise(0.0)
        + F.when(priority, 10.0).otherwise(0.0)
        + F.when(rare, 20.0).otherwise(0.0)
    )
    scored = scored.withColumn("anomaly_score", F.round(F.least(total, F.lit(100.0)), 2))
    score = F.col("anomaly_score")
    severity = (
        F.when((rare & (score >= 25)) | (score >= 80), "critical")
        .when(score >= 55, "high")
        .when(score >= 35, "medium")
        .otherwise("low")
    )
    triggered = rare | (
        (observed >= minimum)
        & ((mean == 0) | (surge >= 2.0) | (dev >= 3.0) | (observed >= F.col("highest") + 2))
    )
    # Wording of the reasons.
    reasons = F.array_compact(
        F.array(
            F.format_string("Observed %d case(s) against a baseline mean of %s.", observed, F.round(mean, 2).cast("string")),
            F.when(surge >= 2.0, F.format_string("Surge ratio reached %s.", surge.cast("string"))),
            F.when(dev >= 3.0, F.format_string("Deviation score reached %s.", dev.cast("string"))),
            F.when(rare, "Rare-disease profile increases anomaly sensitivity.").when(
                priority, "High-priority disease profile increases anomaly sensitivity."
            ),
        )
    )
    return (
        scored.withColumn("severity", severity)
        .filter(triggered & (F.col("severity") != "low"))
        .select(
            "disease_id", "disease_code", "disease_name", "policy_profile", "region_type",
            F.col("diagnosis_date").alias("target_date"),
            F.date_sub("diagnosis_date", n).alias("baseline_start"),
            F.date_sub("diagnosis_date", 1).alias("baseline_end"),
            observed.alias("observed_count"),
            F.round(mean, 2).alias("baseline_mean"),
            F.round("median", 2).alias("baseline_median"),
            F.col("highest").alias("baseline_max"),
            surge.alias("surge_ratio"), dev.alias("deviation_score"), "anomaly_score", "severity",
            reasons.alias("reasons"),
        )
        .orderBy(F.desc("anomaly_score"), "target_date", "disease_code", "region_type")
    )
