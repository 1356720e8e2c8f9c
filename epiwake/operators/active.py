"""Active-case state: the latest visit per (patient, disease) and what follows from it."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epiwake.functions.clinical import infected
from epiwake.session import shuffled
from epiwake.tables import Tables

POINT_MODES = ("exposure", "case")


def latest_visits(visits: DataFrame, scope: Column | None = None) -> DataFrame:
    """Newest visit per (patient, disease) by (date, id).

    Without ``scope`` the newest is looked for inside ``visits`` only, so filter first for a
    window. With ``scope`` the newest is taken over all of ``visits`` and only then tested.
    A rank filter of 1 is cut down per map task before the shuffle, so a pair that owns a
    large share of the table still sends one row per task.
    """
    newest_first = Window.partitionBy("patient_id", "disease_id").orderBy(
        F.desc("diagnosis_date"), F.desc("id")
    )
    latest = (
        visits.withColumn("_rank", F.row_number().over(newest_first))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )
    return latest if scope is None else latest.filter(scope)


def active_visits(visits: DataFrame, scope: Column | None = None) -> DataFrame:
    """Latest visits that are infected; status is read only after the latest is chosen."""
    return latest_visits(visits, scope).filter(infected(F.col("status")))


def flag_active(visits: DataFrame) -> DataFrame:
    """Every visit of the set with an ``is_active`` column."""
    active = active_visits(visits).select("id", F.lit(True).alias("_hit"))
    return visits.join(active, "id", "left").withColumn(
        "is_active", F.coalesce("_hit", F.lit(False))
    ).drop("_hit")


def check_point_mode(mode: str | None) -> str:
    wanted = (mode or "exposure").strip().lower()
    if wanted not in POINT_MODES:
        raise ValueError("point mode is one of: " + ", ".join(POINT_MODES))
    return wanted


def apply_point_mode(points: DataFrame, mode: str | None = None) -> DataFrame:
    """``exposure`` keeps all points, ``case`` the lowest point id of each visit."""
    if check_point_mode(mode) == "exposure":
        return points
    lowest = points.groupBy("visit_id").agg(F.min("id").alias("id"))
    return points.join(lowest, ["visit_id", "id"], "left_semi")


def active_points(
    t: Tables,
    scope: Column | None = None,
    *,
    within: Column | None = None,
    region: str | None = None,
    mode: str | None = None,
) -> DataFrame:
    """Points of active visits with the visit's disease, date, doctor and status.

    ``within`` limits the visits before the latest is chosen, ``scope`` after.
    """
    visits = t.visit if within is None else t.visit.filter(within)
    chosen = active_visits(visits, scope).select(
        F.col("id").alias("visit_id"), "disease_id", "diagnosis_date", "doctor_id", "status"
    )
    points = t.geodata if region is None else t.geodata.filter(F.col("region_type") == region)
    return apply_point_mode(shuffled(points).join(chosen, "visit_id"), mode)


def latest_point_date(t: Tables, disease_id: int | None = None) -> Column:
    """Newest diagnosis date among visits that have a point, as a scalar subquery."""
    visits = t.visit if disease_id is None else t.visit.filter(F.col("disease_id") == disease_id)
    located = visits.select(F.col("id").alias("visit_id"), "diagnosis_date").join(
        t.geodata.select("visit_id"), "visit_id", "left_semi"
    )
    return located.agg(F.max("diagnosis_date")).scalar()


def date_window(
    t: Tables,
    disease_id: int | None = None,
    lookback_days: int | None = None,
    date_from: date | None = None,
    date_to: date | None = None,
) -> Column | None:
    """The date test of a spatial job: explicit bounds win, else a lookback from the newest."""
    day = F.col("diagnosis_date")
    tests = []
    if disease_id is not None:
        tests.append(F.col("disease_id") == disease_id)
    if date_from or date_to or lookback_days is None:
        if date_from:
            tests.append(day >= F.lit(date_from))
        if date_to:
            tests.append(day <= F.lit(date_to))
    else:
        newest = latest_point_date(t, disease_id)
        tests += [day >= F.date_sub(newest, lookback_days), day <= newest]
    condition = None
    for test in tests:
        condition = test if condition is None else condition & test
    return condition


def collect_points(
    t: Tables,
    *,
    disease_id: int | None = None,
    lookback_days: int | None = None,
    date_from: date | None = None,
    date_to: date | None = None,
    region: str | None = None,
    mode: str | None = "exposure",
) -> DataFrame:
    """Active points for clustering: globally latest visits that fall in the window."""
    check_point_mode(mode)
    scope = date_window(t, disease_id, lookback_days, date_from, date_to)
    points = active_points(t, scope, region=region, mode=mode)
    return points.select(
        F.col("id").alias("geodata_id"), "visit_id", "patient_id", "disease_id",
        "diagnosis_date", "latitude", "longitude", "region_type",
    )


def daily_states(visits: DataFrame) -> DataFrame:
    """One row per (patient, disease, date) with the date of the pair's next visit.

    A visit is the latest of its pair inside any window that ends at ``e`` exactly when
    ``diagnosis_date <= e < next_date``, so every sliding-window question can be answered from
    this one table. Collapsing to days first uses map-side partial aggregation and bounds the
    window that follows by the number of calendar days, whatever the skew of a pair.
    """
    # id and status travel in one long, so that the aggregate stays a hash aggregate.
    packed = F.col("id") * 2 + infected(F.col("status")).cast("long")
    per_day = visits.groupBy("patient_id", "disease_id", "diagnosis_date").agg(
        F.max(packed).alias("packed")
    )
    later = Window.partitionBy("patient_id", "disease_id").orderBy("diagnosis_date")
    return per_day.select(
        "patient_id", "disease_id", "diagnosis_date",
        F.shiftright("packed", 1).alias("visit_id"),
        (F.col("packed") % 2 != 0).alias("infected"),
        F.lead("diagnosis_date").over(later).alias("next_date"),
    )
