"""Surveillance tables derived from the generic star-schema test tables.

The same mapping is written once more as SQL common table expressions in
``plans/oracle.py``; both sides must produce identical rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epiwake.session import shuffled
from epiwake.tables import Tables

EVENT_DISEASE = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}
DISEASE_ROWS = {
    # event type: id, code, name, type, vector, risk, score, profile, high priority, rare
    "click": (1, "MEA", "Measles", "viral", "airborne", 5, 4.5, "high_priority", True, False),
    "error": (2, "COL", "Cholera", "bacterial", "water", 4, 3.0, "cluster_sensitive", False, False),
    "purchase": (3, "POL", "Polio", "viral", "fecal_oral", 5, 4.0, "rare", True, True),
    "signup": (4, "FLU", "Seasonal flu", "viral", "droplet", 2, 1.5, "general", False, False),
    "view": (5, "1E32", "Influenza", "respiratory", "droplet", 4, 0.67, "surge_sensitive", False, False),
}
CATALOGUE_CODES = [
    "MEA", "1F03", "1A00", "1C81", "1E70", "1E50.0", "1B93", "1D60.01", "1D65", "1E71",
    "1E32", "1C12", "1A07", "1B1Z", "1C82", "1C1C.0", "1D2Z", "1F4Z", "1A09.0", "1A02",
    "DA22.Z", "CA23", "CA40.Z", "1A31", "FPO", "COVID", "X1", "X2", "X3", "X4",
]
CATALOGUE_TYPES = [
    "epidemic_infectious", "high_alert_notifiable", "cancer_environmental_signal",
    "gastrointestinal", "respiratory", "chronic", "other",
]
CATALOGUE_VECTORS = ["airborne_droplet", "foodborne", "none", "vector_mosquito", "close_contact"]


def _pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _home(pid: Column) -> tuple[Column, Column]:
    lat = F.lit(33.0) + (pid * 7919 % 10007).cast("double") / F.lit(20014.0)
    lon = F.lit(36.0) + (pid * 104729 % 10009).cast("double") / F.lit(20018.0)
    return lat, lon


class StarSchemaSource:
    """Opens the star-schema Parquet files under one folder and maps them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def event_stream(self) -> DataFrame:
        """The events file as a stream; its schema is taken from the stored file."""
        schema = self._read("events").schema
        reader = self.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
        return reader.parquet(self.folder)

    def visit(self, events: DataFrame | None = None, doctors: Column | None = None) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("long")
        if doctors is None:
            doctors = self._read("supplier").agg(F.count(F.lit(1))).scalar()
        events = (self._read("events") if events is None else events).withColumn("k", k)
        disease = F.create_map(*[F.lit(x) for kv in EVENT_DISEASE.items() for x in kv])
        return events.select(
            F.col("event_id").alias("id"),
            (F.col("user_id") * 10 + F.col("k") % 10).alias("patient_id"),
            (F.col("event_id") % doctors).alias("doctor_id"),
            disease[F.col("event_type")].cast("long").alias("disease_id"),
            F.lit("").alias("diagnose"),
            F.to_date("ts").alias("diagnosis_date"),
            F.when(F.col("k") % 4 == 0, "cured").otherwise("infected").alias("status"),
            (F.lit(40.0) + F.col("k") * F.lit(0.5)).alias("weight"),
            (F.col("user_id") % 60 + 130).cast("double").alias("height"),
            _pick(["single", "married", "divorced", "widow"], F.col("k") % 4).alias("marital_status"),
        )

    def disease(self) -> DataFrame:
        fields = [
            ("id", "long"), ("disease_code", "string"), ("name", "string"), ("type", "string"),
            ("transmission_vector", "string"), ("risk_level", "int"), ("infection_score", "double"),
            ("policy_profile", "string"), ("high_priority", "boolean"), ("rare_disease", "boolean"),
        ]
        kinds = self._read("events").select("event_type").distinct()
        columns = []
        for i, (name, dtype) in enumerate(fields):
            values = {kind: row[i] for kind, row in DISEASE_ROWS.items()}
            lookup = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
            columns.append(lookup[F.col("event_type")].cast(dtype).alias(name))
        return kinds.select(*columns)

    def catalogue(self) -> DataFrame:
        """A wide reference list of diseases, one row per part."""
        key = F.col("p_partkey")
        return self._read("part").select(
            key.alias("id"),
            _pick(CATALOGUE_CODES, key % 30).alias("disease_code"),
            F.concat(F.col("p_name"), F.when(key % 50 == 0, " Plague").otherwise("")).alias("name"),
            _pick(CATALOGUE_TYPES, key % 7).alias("type"),
            _pick(CATALOGUE_VECTORS, key % 5).alias("transmission_vector"),
            (F.col("p_size") % 6).cast("int").alias("risk_level"),
            ((key * 13 % 130).cast("double") / F.lit(20.0)).alias("infection_score"),
            F.col("p_brand").alias("symptoms"),
        )

    def patient(self) -> DataFrame:
        pid = F.col("c_custkey")
        lat, lon = _home(pid)
        works = pid % 3 != 0
        return self._read("customer").select(
            pid.alias("id"),
            F.col("c_name").alias("national_number"),
            F.col("c_name").alias("name"),
            F.date_add(F.lit("1940-01-01").cast("date"), (pid * 37 % 25000).cast("int")).alias("birth_date"),
            F.when(pid % 2 == 0, "female").otherwise("male").alias("gender"),
            lat.alias("residence_lat"),
            lon.alias("residence_long"),
            F.when(works, lat + F.lit(0.004)).alias("work_lat"),
            F.when(works, lon + F.lit(0.004)).alias("work_long"),
        )

    def geodata(self, visit: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
        visit = (self.visit() if visit is None else visit).select("id", "patient_id", *keep)
        pid = F.col("patient_id")
        lat, lon = _home(pid)

        def point(region: str, shift: float, offset: int) -> Column:
            return F.struct(
                (F.col("id") * 2 + offset).alias("gid"),
                (lat + F.lit(shift) if shift else lat).alias("lat"),
                (lon + F.lit(shift) if shift else lon).alias("lon"),
                F.lit(region).alias("region"),
            )

        home, work = point("home", 0.0, 0), point("work", 0.004, 1)
        points = F.when(pid % 3 != 0, F.array(home, work)).otherwise(F.array(home))
        return visit.select("id", "patient_id", *keep, F.explode(points).alias("p")).select(
            *keep, F.col("p.gid").alias("id"), "patient_id", F.col("id").alias("visit_id"),
            F.col("p.lat").alias("latitude"), F.col("p.lon").alias("longitude"),
            F.col("p.region").alias("region_type"),
        )

    def hospital(self) -> DataFrame:
        key = F.col("n_nationkey")
        region = self._read("region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
        return self._read("nation").join(region, "n_regionkey").select(
            key.cast("long").alias("id"),
            F.col("n_name").alias("name"),
            (F.lit(33.0) + key.cast("double") / F.lit(50.0)).alias("hospital_lat"),
            (F.lit(36.0) + key.cast("double") / F.lit(50.0)).alias("hospital_long"),
            F.col("n_name").alias("location"),
            F.col("r_name").alias("city"),
        )

    def doctor(self) -> DataFrame:
        return self._read("supplier").select(
            F.col("s_suppkey").alias("id"),
            F.col("s_suppkey").alias("user_id"),
            _pick(["Epidemiology", "Internal Medicine"], F.col("s_suppkey") % 2).alias("specialization"),
            F.col("s_nationkey").cast("long").alias("hospital_id"),
        )

    def users(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self._read("supplier").select(
            key.alias("id"), F.col("s_name").alias("username"),
            F.concat(F.col("s_name"), F.lit("@example.org")).alias("email"),
            F.col("s_name").alias("real_name"),
            _pick(["doctor", "nurse", "admin", "doctor", ""], key % 5).alias("role"),
        )

    def report(self) -> DataFrame:
        key = F.col("o_orderkey")
        start = F.date_add(F.lit("2024-01-01").cast("date"), (key % 30).cast("int"))
        length = (F.col("o_custkey") % 9 - 1).cast("int")
        visit = self.visit().select(F.col("id").alias("o_orderkey"), F.col("disease_id").alias("visit_disease"))
        counts = [
            ("nearby_case_count", key % 7), ("current_case_count", key % 11),
            ("previous_case_count", key % 5),
        ]
        return self._read("orders").join(shuffled(visit), "o_orderkey", "left").select(
            key.alias("id"),
            F.timestamp_add("MINUTE", (key % 43200).cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("generated_at"),
            F.coalesce("visit_disease", key % 5 + 1).alias("disease_id"),
            F.when(F.col("visit_disease").isNotNull(), key).alias("trigger_visit_id"),
            start.alias("analysis_period_start"),
            F.date_add(start, length).alias("analysis_period_end"),
            F.create_map(*[F.lit(x) for kv in {
                "1-URGENT": "critical", "2-HIGH": "high", "3-MEDIUM": "medium",
                "4-NOT SPECIFIED": "low", "5-LOW": "low"}.items() for x in kv])[F.col("o_orderpriority")].alias("alert_level"),
            F.lit("").alias("summary"),
            (F.col("o_totalprice") / F.lit(5000.0)).alias("risk_score"),
            *[expr.cast("int").alias(name) for name, expr in counts],
            ((key % 13).cast("double") / F.lit(4.0)).alias("growth_rate"),
            ((key % 17).cast("double") / F.lit(4.0)).alias("surge_ratio"),
            F.array(F.lit("seed")).alias("reasons"),
            F.create_map(*[F.lit(x) for kv in {"F": "resolved", "O": "new", "P": "reviewed"}.items() for x in kv])[
                F.col("o_orderstatus")].alias("status"),
        )

    def lab_test(self) -> DataFrame:
        result = F.create_map(*[F.lit(x) for kv in {
            "AF": "Abnormal high WBC", "AO": "Positive", "NF": "Within normal limits",
            "NO": "Not detected", "RF": "Reactive", "RO": "Low platelets"}.items() for x in kv])
        return self._read("lineitem").select(
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
            F.col("l_orderkey").alias("visit_id"),
            result[F.concat("l_returnflag", "l_linestatus")].alias("result"),
            F.col("l_shipdate").alias("test_date"),
        )

    def geocluster(self) -> DataFrame:
        key = F.col("c_custkey")
        lat, lon = _home(key * 3 + 1)
        return self._read("customer").select(
            key.alias("id"), lat.alias("center_lat"), lon.alias("center_long"),
            (F.lit(0.5) + (key % 40).cast("double") / F.lit(10.0)).alias("radius"),
            (key % 5 + 1).alias("disease_id"),
            (key % 23).cast("int").alias("case_count"),
            (key % 6).cast("int").alias("risk_level"),
            F.timestamp_add("MINUTE", (key * 17 % 43200).cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("generated_at"),
        )

    def tables(self) -> Tables:
        return Tables(
            visit=self.visit(), disease=self.disease(), geodata=self.geodata(),
            patient=self.patient(), doctor=self.doctor(), hospital=self.hospital(),
            users=self.users(), report=self.report(), geocluster=self.geocluster(),
            lab_test=self.lab_test(),
        )
