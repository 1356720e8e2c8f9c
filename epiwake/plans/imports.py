"""The import job: files in order of their dependencies, each against a snapshot of the tables."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epiwake.plans import jobs
from epiwake.session import cut_lineage
from epiwake.sources import load
from epiwake.tables import Tables

# The columns each group's file must have.
HEADERS = {
    "hospitals": ["name", "latitude", "longitude", "location", "city"],
    "users": ["id", "username", "email", "first_name", "last_name", "real_name", "phon_number", "role"],
    "doctors": ["id", "user_id", "hospital_id", "specialization"],
    "patients": ["id", "national_number", "name", "birth_date", "gender", "residence_lat", "residence_long", "work_lat", "work_long"],
    "visits": ["id", "patient_id", "doctor_id", "disease_id", "diagnosis_date", "status", "weight", "height", "marital_status"],
}
TABLE_OF = {"hospitals": "hospital", "users": "users", "doctors": "doctor", "patients": "patient"}


@dataclass(frozen=True)
class Imported:
    """The tables after an import, the refused rows of each group, and what monitoring added.

    ``delta`` has a row (table_name, id) for each new report and hotspot; with ``dry_run`` the tables are
    those before, and ``counts`` (group, action, rows) says what would be done.
    """

    tables: Tables
    refused: dict[str, DataFrame] = field(default_factory=dict)
    counts: DataFrame | None = None
    delta: DataFrame | None = None


def new_ids(before: Tables, after: Tables) -> DataFrame:
    """(table_name, id) of the reports and hotspots that a snapshot does not have."""
    parts = []
    for name in ("report", "geocluster"):
        fresh = getattr(after, name).select("id").join(getattr(before, name).select("id"), "id", "left_anti")
        parts.append(fresh.select(F.lit(name).alias("table_name"), "id"))
    return parts[0].unionByName(parts[1])


def _clean(group: str, raw: DataFrame, t: Tables) -> load.Loaded:
    if group == "doctors":
        return load.clean_doctors(raw, t.hospital)
    return getattr(load, f"clean_{group}")(raw)


def _upserted(table: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The new version of a table, and (action, rows)."""
    merged = cut_lineage(load.upsert(table, incoming, ["id"]))
    counts = merged.filter("change <> 'kept'").groupBy(F.col("change").alias("action")).agg(F.count(F.lit(1)).alias("rows"))
    return merged.select(*table.columns), counts


def import_files(
    spark: SparkSession, paths: dict[str, str], t: Tables, as_of: datetime, *, only: set[str] | None = None,
    stop_after: int | None = None, dry_run: bool = False, replay_existing: bool = False,
) -> Imported:
    """Load the files of ``paths`` (group to path) in the order of ``load.GROUPS``.

    Hospitals, users, doctors and patients are inserted or updated by id; the last row of an id wins.
    Visits are only inserted; their points follow from the patients' addresses and go through monitoring,
    with ``replay_existing`` together with the points of visits that are there already. Refused rows are
    returned with their reason. Each step reads the stored result of the one before.
    """
    before, refused, counts = t, {}, None

    def note(group: str, part: DataFrame) -> None:
        nonlocal counts
        part = part.select(F.lit(group).alias("group"), "action", F.col("rows").cast("long").alias("rows"))
        counts = part if counts is None else counts.unionByName(part)

    for group in load.GROUPS:
        if group not in paths or (only and group not in only):
            continue
        raw = load.stop_after(load.read_csv(spark, paths[group], HEADERS[group]), stop_after)
        loaded = _clean(group, cut_lineage(raw), t)
        refused[group] = loaded.bad
        note(group, loaded.bad.agg(F.count(F.lit(1)).alias("rows")).withColumn("action", F.lit("refused")))
        if group != "visits":
            name = TABLE_OF[group]
            incoming = cut_lineage(load.last_row_wins(loaded.good, ["id"], "row_number"))
            table, changes = _upserted(getattr(t, name), incoming)
            note(group, changes)
            t = replace(t, **{name: table})
            if group == "patients" and t.medical_history is not None:
                absent = load.missing_histories(incoming.select("id"), t.medical_history).withColumn("id", F.lit(None).cast("long"))
                columns = t.medical_history.columns
                histories = load.assign_ids(absent.select(*columns), t.medical_history)
                t = replace(t, medical_history=cut_lineage(t.medical_history.unionByName(histories)))
            continue
        load.require_references(loaded.good, t)
        plan = load.plan_visits(cut_lineage(loaded.good), t.visit, replay_existing)
        note(group, load.dry_run(plan).withColumnRenamed("visits", "rows"))
        if not dry_run:
            t = _insert_visits(t, plan, as_of)
    if dry_run:
        return Imported(before, refused, counts)
    return Imported(t, refused, counts, new_ids(before, t))


def _insert_visits(t: Tables, plan: load.VisitPlan, as_of: datetime) -> Tables:
    inserted = cut_lineage(plan.insert.select(*t.visit.columns))
    visits = cut_lineage(t.visit.unionByName(inserted))
    fresh = load.derive_points(inserted, t.patient, t.geodata).withColumn("id", F.lit(None).cast("long"))
    points = cut_lineage(load.assign_ids(fresh.select(*t.geodata.columns), t.geodata))
    t = replace(t, visit=visits, geodata=cut_lineage(t.geodata.unionByName(points)))
    again = t.geodata.join(plan.replay.select(F.col("id").alias("visit_id")), "visit_id", "left_semi").select(*points.columns)
    _, t = jobs.monitor(t, points.unionByName(again), as_of)
    return replace(t, report=cut_lineage(t.report), geocluster=cut_lineage(t.geocluster))
