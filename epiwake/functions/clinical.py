"""Scalar derivations over visit, patient, lab and report columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lab wording rules for the export and for the risk features.
EXPORT_NORMAL_WORDS = ["normal", "negative", "within range", "within normal", "not detected"]
EXPORT_ABNORMAL_WORDS = [
    "abnormal", "positive", "high", "low", "reactive", "detected", "critical", "elevated",
]
RISK_NORMAL_WORDS = ["normal", "negative", "within range", "not detected"]
RISK_ABNORMAL_WORDS = ["high", "low", "positive", "critical", "detected", "elevated"]

# Alert levels and the numbers attached to them.
ALERT_PRIORITY = {"no_alert": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
ALERT_RISK_LEVEL = {"no_alert": 0, "low": 1, "medium": 2, "high": 4, "critical": 5}
ACTIVE_ALERT_LEVELS = ["medium", "high", "critical"]
ACTIVE_REPORT_STATUSES = ["new", "reviewed"]
TRUE_WORDS = ["1", "true", "yes", "on"]


def literal_map(values: dict) -> Column:
    pairs = [F.lit(part) for item in values.items() for part in item]
    return F.create_map(*pairs)


def clean_text(col: Column, max_length: int | None = None) -> Column:
    text = F.trim(F.coalesce(col.cast("string"), F.lit("")))
    return F.substring(text, 1, max_length) if max_length is not None else text


def blank_to_null(col: Column) -> Column:
    return F.nullif(F.trim(col.cast("string")), F.lit(""))


def to_bool(col: Column) -> Column:
    return F.coalesce(F.lower(F.trim(col.cast("string"))).isin(TRUE_WORDS), F.lit(False))


def to_int(col: Column, default: int | None = None) -> Column:
    parsed = blank_to_null(col).try_cast("long")
    return parsed if default is None else F.coalesce(parsed, F.lit(default).cast("long"))


def to_float(col: Column, default: float | None = None) -> Column:
    parsed = blank_to_null(col).try_cast("double")
    return parsed if default is None else F.coalesce(parsed, F.lit(float(default)))


def age_years(birth: Column, on: Column) -> Column:
    before_birthday = F.date_format(on, "MMdd") < F.date_format(birth, "MMdd")
    return F.year(on) - F.year(birth) - before_birthday.cast("int")


def _bmi(weight: Column, height_cm: Column) -> Column:
    metres = height_cm / F.lit(100.0)
    return F.when(height_cm > 0, weight / (metres * metres))


def export_bmi(weight: Column, height_cm: Column) -> Column:
    return F.round(_bmi(weight, height_cm), 2)


def risk_bmi(weight: Column, height_cm: Column) -> Column:
    return F.coalesce(F.round(_bmi(weight, height_cm), 4), F.lit(0.0))


def _mentions(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def _abnormal(result: Column, normal: list[str], abnormal: list[str]) -> Column:
    text = F.lower(F.trim(F.coalesce(result, F.lit(""))))
    return text.contains("abnormal") | (~_mentions(text, normal) & _mentions(text, abnormal))


def export_abnormal(result: Column) -> Column:
    return _abnormal(result, EXPORT_NORMAL_WORDS, EXPORT_ABNORMAL_WORDS)


def risk_abnormal(result: Column) -> Column:
    return _abnormal(result, RISK_NORMAL_WORDS, RISK_ABNORMAL_WORDS)


def is_active_report(status: Column, level: Column) -> Column:
    return status.isin(ACTIVE_REPORT_STATUSES) & level.isin(ACTIVE_ALERT_LEVELS)


def alert_priority(level: Column) -> Column:
    return literal_map(ALERT_PRIORITY)[level]


def alert_risk_level(level: Column) -> Column:
    return F.coalesce(literal_map(ALERT_RISK_LEVEL)[level], F.lit(0))


def report_alert_level(risk_score: Column, cases: Column, surge: Column) -> Column:
    return (
        F.when((risk_score >= 80) | (cases >= 6) | (surge >= 2.5), "critical")
        .when((risk_score >= 45) | (cases >= 3) | (surge >= 1.5), "high")
        .when((risk_score >= 20) | (cases >= 1), "medium")
        .otherwise("low")
    )


def cluster_risk_level(rare: Column, priority: Column, risk: Column, points: Column) -> Column:
    def at_least(floor: int) -> Column:
        return F.greatest(F.lit(floor), F.least(F.lit(5), risk))

    return (
        F.when(rare, F.lit(5))
        .when(priority & (points >= 2), at_least(4))
        .when(points >= 6, F.lit(5))
        .when(points >= 4, at_least(4))
        .otherwise(at_least(2))
    )


def infected(status: Column) -> Column:
    return F.lower(status) == "infected"


def valid_coordinates(lat: Column, lon: Column) -> Column:
    # NaN fails <= in Spark because it sorts above every number.
    ok = lat.between(-90, 90) & lon.between(-180, 180)
    return F.coalesce(ok, F.lit(False))


def ratios(current: Column, previous: Column) -> tuple[Column, Column]:
    """Growth rate and surge ratio of two window counts, rounded to 4 digits."""
    had, has = previous > 0, current > 0
    # nullif guards the division: with ANSI mode a zero divisor raises even in a dead branch.
    base = F.nullif(previous, F.lit(0).cast("long")).cast("double")
    growth = F.when(had, (current - previous) / base).when(has, 1.0).otherwise(0.0)
    surge = F.when(had, current / base).when(has, current.cast("double")).otherwise(0.0)
    return F.round(growth, 4), F.round(surge, 4)


def preferred_point_order(region: Column, point_id: Column) -> Column:
    """Sort key that puts the first home point ahead of every other point."""
    return F.struct((region != "home").alias("not_home"), point_id.alias("pid"))
