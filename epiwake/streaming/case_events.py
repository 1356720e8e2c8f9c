"""The live case feed: change records in, added / updated / removed events out."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from epiwake.tables import Tables

# Event names and routing groups.
ADDED, UPDATED, REMOVED = "case.added", "case.updated", "case.removed"
ALL_GROUP, DISEASE_GROUP, TYPE_GROUP = "map.active.all", "map.active.disease.", "map.active.type."

# One change record: a saved point (kind geodata) or a saved visit (kind visit).
CHANGE_SCHEMA = (
    "seq long, kind string, created boolean, visit_id long, patient_id long, disease_id long, "
    "doctor_id long, diagnosis_date date, status string, geodata_id long, region_type string, "
    "latitude double, longitude double"
)
EVENT_SCHEMA = (
    "seq long, event_type string, cause_id long, geodata_id long, visit_id long, patient_id long, "
    "disease_id long, doctor_id long, diagnosis_date date, status string, region_type string, "
    "latitude double, longitude double"
)
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# A state holds the pairs of this many neighbouring patient ids, two to the power of ``PATIENT_BITS``.
PATIENT_BITS = 6


class CaseState(StatefulProcessor):
    """Visits and points of one disease and some neighbouring patients, in keyed state.

    Each call to the state is a round trip, so pairs share a state and a micro-batch reads and appends a
    state's lists as a whole. A later entry of a list replaces an earlier one of the same id.

    A visit with an older date never becomes the latest of its pair, however late it arrives,
    so its points come out as removed; no watermark is needed.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.visits = handle.getListState("visits", "patient_id long, visit_id long, day date, status string, doctor_id long")
        self.points = handle.getListState("points", "patient_id long, geodata_id long, visit_id long, region string, lat double, lon double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        disease = None if key[0] is None else int(key[0])
        changes = pd.concat(list(rows)).sort_values(["seq", "kind", "geodata_id"], ascending=[True, False, True])
        visits_of, points_of = defaultdict(dict), defaultdict(dict)
        sizes = [_read(self.visits, visits_of), _read(self.points, points_of)]
        new_visits: list[tuple] = []
        new_points: list[tuple] = []
        out: list[tuple] = []
        names = ["seq", "kind", "created", "visit_id", "patient_id", "doctor_id", "diagnosis_date", "status", "geodata_id", "region_type", "latitude", "longitude"]
        for seq, kind, created, visit_id, patient, doctor, day, status, point_id, region, lat, lon in zip(*(changes[c].tolist() for c in names)):
            patient, visit_id = None if pd.isna(patient) else int(patient), int(visit_id)
            cause = int(point_id) if pd.notna(point_id) else None
            visits, points = visits_of[patient], points_of[patient]

            def emit(event: str, point: int) -> None:
                of, *place = points[point]
                seen, state, by = visits[of]
                out.append((int(seq), event, cause, point, of, patient, disease, by, seen, state, *place))

            visits[visit_id] = (day, status, int(doctor))
            new_visits.append((patient, visit_id, *visits[visit_id]))
            if kind == "geodata":
                points[cause] = (visit_id, region, float(lat), float(lon))
                new_points.append((patient, cause, *points[cause]))
                affected = [cause]
            elif created:
                continue
            else:
                affected = sorted(p for p, v in points.items() if v[0] == visit_id)
            latest = max(visits, key=lambda v: (visits[v][0], v))
            live = latest == visit_id and str(status).lower() == "infected"
            fresh = kind == "geodata" and bool(created)
            for point in affected:
                emit((ADDED if fresh else UPDATED) if live else REMOVED, point)
            if latest == visit_id:
                for point in sorted(p for p, v in points.items() if v[0] != visit_id):
                    emit(REMOVED, point)
        _store(self.visits, visits_of, new_visits, sizes[0])
        _store(self.points, points_of, new_points, sizes[1])
        if out:
            frame = pd.DataFrame(out, columns=[f.strip().split(" ")[0] for f in EVENT_SCHEMA.split(",")])
            for name in ("cause_id", "patient_id", "disease_id"):
                frame[name] = frame[name].astype("Int64")
            yield frame

    def close(self) -> None:
        pass


def _read(state, held: dict[int | None, dict]) -> int:
    """Fill ``held`` (entry by patient and id) from a list state; the number of its entries."""
    size = 0
    if state.exists():
        for patient, name, *entry in state.get():
            held[patient][name] = tuple(entry)
            size += 1
    return size


def _store(state, held: dict[int | None, dict], added: list[tuple], size: int) -> None:
    """Append the new entries; a list of which more than half is replaced is written anew."""
    if not added:
        return
    live = sum(len(of) for of in held.values())
    if size and size + len(added) > 2 * live:
        state.put([(patient, name, *entry) for patient, of in held.items() for name, entry in of.items()])
    else:
        state.appendList(added)


def case_events(changes: DataFrame) -> DataFrame:
    """Events of a change stream; the session must use the RocksDB state store."""
    return changes.withColumn("patients", F.shiftright("patient_id", PATIENT_BITS)).groupBy(
        "disease_id", "patients"
    ).transformWithStateInPandas(CaseState(), outputStructType=EVENT_SCHEMA, outputMode="Append", timeMode="None")


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def describe(events: DataFrame, t: Tables) -> DataFrame:
    """Add the disease and hospital columns subscribers filter on."""
    disease = t.disease.select(
        F.col("id").alias("disease_id"), "disease_code", F.col("name").alias("disease_name"),
        F.col("type").alias("disease_type"),
    )
    doctor = t.doctor.select(F.col("id").alias("doctor_id"), F.col("hospital_id").alias("doctor_hospital_id"))
    return events.join(disease, "disease_id").join(doctor, "doctor_id", "left")


def group_token(col: Column) -> Column:
    text = F.trim(F.coalesce(col, F.lit("unknown")))
    token = F.substring(F.regexp_replace(text, "[^a-zA-Z0-9_.-]", "_"), 1, 80)
    return F.when(token == "", "unknown").otherwise(token)


def route(described: DataFrame) -> DataFrame:
    """One row per event and subscriber group."""
    code, kind = F.col("disease_code"), F.col("disease_type")
    groups = F.array_compact(
        F.array(
            F.lit(ALL_GROUP),
            F.when(code != "", F.concat(F.lit(DISEASE_GROUP), group_token(F.upper(code)))),
            F.when(kind != "", F.concat(F.lit(TYPE_GROUP), group_token(F.lower(kind)))),
        )
    )
    return described.withColumn("group_name", F.explode(groups))


def for_subscriber(
    described: DataFrame, *, hospital_id: int | None = None, disease_code: str | None = None,
    disease_type: str | None = None, start: date | None = None, end: date | None = None,
) -> DataFrame:
    """Events one subscriber sees. The disease type is compared as written, case included."""
    tests = []
    if hospital_id is not None:
        tests.append(F.col("doctor_hospital_id") == hospital_id)
    if disease_code:
        tests.append(F.col("disease_code") == disease_code.strip().upper())
    if disease_type:
        tests.append(F.col("disease_type") == disease_type.strip())
    if start:
        tests.append(F.col("diagnosis_date") >= F.lit(start))
    if end:
        tests.append(F.col("diagnosis_date") <= F.lit(end))
    for test in tests:
        described = described.filter(test)
    return described


def changes_from_points(points: DataFrame, visits: DataFrame) -> DataFrame:
    """Change records for newly saved points, in point order (batch or static side)."""
    v = visits.select(
        F.col("id").alias("visit_id"), "disease_id", "doctor_id", "diagnosis_date", "status"
    )
    return points.join(v, "visit_id").select(
        F.col("id").alias("seq"), F.lit("geodata").alias("kind"), F.lit(True).alias("created"),
        "visit_id", "patient_id", "disease_id", "doctor_id", "diagnosis_date", "status",
        F.col("id").alias("geodata_id"), "region_type", "latitude", "longitude",
    )


def events_of_saved_points(changes: DataFrame) -> DataFrame:
    """The events that newly saved points cause, from a stored change table.

    Batch counterpart of ``case_events`` for points saved in ``seq`` order, used to rebuild or
    check a feed. A point's own event depends on whether its visit is the latest saved so far
    of its pair; if it is, all points of the pair's other visits saved so far are removed.
    """
    so_far = Window.partitionBy("patient_id", "disease_id").orderBy("seq").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    place = ["visit_id", "doctor_id", "diagnosis_date", "status", "region_type", "latitude", "longitude"]
    ranked = changes.withColumn("newest", F.max(F.struct("diagnosis_date", "visit_id")).over(so_far))
    latest = F.col("newest.visit_id") == F.col("visit_id")
    live = latest & (F.lower("status") == "infected")
    key = ["seq", "cause_id", "geodata_id", "patient_id", "disease_id"]
    caused = ranked.withColumns({"latest": latest, "cause_id": F.col("geodata_id")})
    own = caused.select(*key, F.when(live, ADDED).otherwise(REMOVED).alias("event_type"), *place)
    saver = caused.filter("latest").select(
        "patient_id", "disease_id", "seq", "cause_id", F.col("visit_id").alias("saved_visit")
    )
    older = changes.select("patient_id", "disease_id", F.col("seq").alias("old_seq"), "geodata_id", *place)
    removed = saver.join(older, ["patient_id", "disease_id"]).filter(
        (F.col("old_seq") < F.col("seq")) & (F.col("visit_id") != F.col("saved_visit"))
    ).select(*key, F.lit(REMOVED).alias("event_type"), *place)
    return own.unionByName(removed)


def run_to_table(changes: DataFrame, folder: str, state_partitions: int | None = None) -> DataFrame:
    """Drain the change stream into a Parquet table and open it."""
    spark = changes.sparkSession
    names = ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")
    before = {n: spark.conf.get(n, None) for n in names}
    spark.conf.set(names[0], STATE_STORE)
    spark.conf.set(names[1], str(state_partitions or spark.sparkContext.defaultParallelism))
    try:
        query = (
            case_events(changes).writeStream.format("parquet").outputMode("append")
            .option("path", f"{folder}/events").option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    return spark.read.schema(EVENT_SCHEMA).parquet(f"{folder}/events")
