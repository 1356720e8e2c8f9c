"""The registered queries: one entry per operator group, over the star-schema tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epiwake.functions import clinical
from epiwake.operators import (
    active, anomaly, counts, datasets, dbscan, filters, forest, hdbscan, hotspots, outbreak, policy, quality,
    report_upkeep, reports, risk, spatial, trend,
)
from epiwake.plans import imports, jobs
from epiwake.session import shared_dir, tune
from epiwake.sources import fixes, load, sinks
from epiwake.sources.adapter import StarSchemaSource
from epiwake.streaming import case_events as feed
from epiwake.streaming import monitoring
from epiwake.tables import SCHEMAS, Tables

Query = Callable[[SparkSession, str], DataFrame]
HOSPITAL = 3


def _on_tables(build: Callable[[Tables], DataFrame]) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(StarSchemaSource(tune(spark), folder).tables())

    return run


def _on_source(build: Callable[[StarSchemaSource], DataFrame]) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(StarSchemaSource(tune(spark), folder))

    return run


def active_visits_global(t: Tables) -> DataFrame:
    return active.active_visits(t.visit).select("id", "patient_id", "disease_id", "diagnosis_date")


def active_visits_window(t: Tables) -> DataFrame:
    window = active.date_window(t, lookback_days=14)
    return active.active_visits(t.visit.filter(window)).select(
        "id", "patient_id", "disease_id", "diagnosis_date"
    )


def visit_activity(t: Tables) -> DataFrame:
    return active.flag_active(t.visit).groupBy("disease_id", "is_active").agg(
        F.count(F.lit(1)).alias("visits")
    )


def active_points_case_mode(t: Tables) -> DataFrame:
    return active.collect_points(t, lookback_days=14, mode="case").select(
        "geodata_id", "visit_id", "disease_id", "diagnosis_date", "region_type"
    )


def active_point_list(t: Tables) -> DataFrame:
    return filters.active_point_list(
        t, region="home", hospital_id=HOSPITAL, disease=2, date_from=date(2024, 1, 5)
    ).select(F.col("id").alias("geodata_id"), "visit_id", "patient_id", "diagnosis_date")


MAP_COLUMNS = [
    "geodata_id", "visit_id", "patient_id", "disease_code", "disease_type", "doctor_id",
    "doctor_hospital_id", "diagnosis_date", "status", "region_type",
]


def map_active_cases(t: Tables) -> DataFrame:
    return filters.map_cases(t).select(*MAP_COLUMNS)


def map_page(t: Tables) -> DataFrame:
    """The feed as a caller asks for it with a limit."""
    return filters.map_cases(t, filters.MapFilter(limit=500)).select(*MAP_COLUMNS)


def map_historical_cases(t: Tables) -> DataFrame:
    chosen = filters.MapFilter(
        disease_code=" mea ", start_date=date(2024, 1, 5), region="work", status="infected"
    )
    return filters.map_cases(t, chosen, active=False).select(*MAP_COLUMNS)


def map_hospital_cases(t: Tables) -> DataFrame:
    chosen = filters.MapFilter(disease_type="VIRAL")
    return filters.map_cases(t, chosen, hospital_id=HOSPITAL).select(*MAP_COLUMNS)


def patient_scope(t: Tables) -> DataFrame:
    return filters.patients_in_hospital(t, HOSPITAL).select("id", "national_number")


def hospital_scope(t: Tables) -> DataFrame:
    parts = {
        "visit": filters.visits_in_hospital(t, HOSPITAL),
        "geodata": filters.by_visit_in_hospital(t.geodata, t, HOSPITAL),
        "lab_test": filters.by_visit_in_hospital(t.lab_test, t, HOSPITAL),
        "doctor": filters.doctors_in_hospital(t, HOSPITAL),
        "hospital": filters.hospitals_visible(t, HOSPITAL),
    }
    rows = [df.agg(F.count(F.lit(1)).alias("visible_rows")).withColumn("table_name", F.lit(n)) for n, df in parts.items()]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def active_alerts(t: Tables) -> DataFrame:
    return filters.active_alerts(t, min_risk=20.0).select(
        "id", "disease_id", "trigger_visit_id", "alert_level", "status", "risk_score"
    )


def active_hotspots(t: Tables) -> DataFrame:
    return filters.active_hotspots(t, min_case_count=3).select(
        "id", "disease_id", "risk_level", "case_count", "generated_at"
    )


def patient_history(t: Tables) -> DataFrame:
    return filters.patient_history(t)


def visit_page(t: Tables) -> DataFrame:
    chosen = filters.filter_visits(t.visit, disease=4, date_to=date(2024, 1, 25))
    return filters.page(filters.newest_visits_first(chosen), number=2).select(
        "id", "patient_id", "doctor_id", "diagnosis_date", "status"
    )


def generated_reports(t: Tables) -> DataFrame:
    return reports.generate_reports(t, region="home", date_from=date(2024, 1, 16)).drop("reasons", "summary", "trigger_visit_id")


def anomalies(t: Tables) -> DataFrame:
    return anomaly.detect_anomalies(t).drop("reasons")


def trend_snapshots(t: Tables) -> DataFrame:
    return trend.trend_snapshots(t, policy.alert_policies(t.disease))


def trend_snapshots_by_region(t: Tables) -> DataFrame:
    return trend.trend_snapshots(t, policy.alert_policies(t.disease), region=True)


def nearby_cases(t: Tables) -> DataFrame:
    contexts = outbreak.contexts_of(t)
    return spatial.nearby_cases(
        t, contexts, policy.alert_policies(t.disease), columns=["geodata_id", "case_visit_id", "case_date", "distance_km"]
    )


OUTBREAK_COLUMNS = [
    "geodata_id", "visit_id", "disease_code", "diagnosis_date", "context_active", "alert_level", "score",
    "nearby_case_count", "local_case_count", "current_count", "previous_count", "growth_rate",
    "surge_ratio", "severity_points", "density_points", "trend_points", "rarity_points",
    "should_create_report", "should_create_cluster",
]


def outbreak_evaluation(t: Tables) -> DataFrame:
    contexts = outbreak.contexts_of(t)
    return outbreak.evaluate_outbreaks(t, contexts, policy.alert_policies(t.disease)).select(*OUTBREAK_COLUMNS)


def exposure_evaluation(t: Tables) -> DataFrame:
    contexts = outbreak.contexts_of(t, own_region=True)
    return outbreak.evaluate_outbreaks(
        t, contexts, policy.alert_policies(t.disease), regional=True
    ).select(*OUTBREAK_COLUMNS)


def outbreak_texts(t: Tables) -> DataFrame:
    """Reasons of every outbreak result and the summary that a report about it gets."""
    analyses = outbreak.evaluate_outbreaks(t, outbreak.contexts_of(t), policy.alert_policies(t.disease))
    told = report_upkeep.results(t, analyses)
    return told.select("geodata_id", F.array_join("reasons", " ").alias("reasons"), "summary")


def anomaly_texts(t: Tables) -> DataFrame:
    return anomaly.detect_anomalies(t).select("disease_id", "region_type", "target_date", F.array_join("reasons", " ").alias("reasons"))


def report_texts(t: Tables) -> DataFrame:
    made = reports.generate_reports(t, region="home", date_from=date(2024, 1, 16))
    return made.select("disease_id", F.array_join("reasons", " ").alias("reasons"), "summary")


def visit_evaluation(t: Tables) -> DataFrame:
    """Each visit at its first point of a region, with counts and policy of that region."""
    chosen = outbreak.first_points(t.geodata, region="work")
    contexts = outbreak.contexts_of(t, chosen, own_region=True)
    return outbreak.evaluate_outbreaks(t, contexts, policy.alert_policies(t.disease), regional=True).select(*OUTBREAK_COLUMNS)


def disease_classification(s: StarSchemaSource) -> DataFrame:
    return policy.classify_diseases(s.catalogue()).select(
        "id", "disease_code", "policy_profile", "high_priority", "rare_disease"
    )


def alert_policies(s: StarSchemaSource) -> DataFrame:
    return policy.alert_policies(policy.classify_diseases(s.catalogue()))


TODAY = date(2024, 6, 1)


def dq_violations(s: StarSchemaSource) -> DataFrame:
    t = s.tables()
    checked = quality.check_all(t, TODAY)
    listed = policy.classify_diseases(s.catalogue())
    checked["catalogue"] = quality.check_diseases(listed)
    return quality.summarise(checked)


def dq_every_rule(s: StarSchemaSource) -> DataFrame:
    """Violations by rule over the given tables with a defect of each kind at every n-th key."""
    def at(key, n):  # noqa: ANN001, ANN202
        return key % n == 0

    def spoil(df: DataFrame, key: str, defects: dict[str, tuple[int, object]]) -> DataFrame:
        k = F.col(key)
        return df.withColumns({c: F.when(at(k, n), value if isinstance(value, Column) else F.lit(value)).otherwise(F.col(c)) for c, (n, value) in defects.items()})

    t, null = s.tables(), F.lit(None).cast("double")
    people = spoil(s.patient().withColumn("work_long", F.coalesce("work_long", F.col("residence_long"))).withColumn("work_lat", F.coalesce("work_lat", F.col("residence_lat"))), "id", {
        "gender": (7, "x"), "residence_lat": (11, 91.0), "residence_long": (13, null), "work_lat": (17, null), "work_long": (19, -180.5),
        "birth_date": (23, F.lit(date(2030, 1, 1))), "name": (29, "  "), "national_number": (31, "")})
    listed = spoil(policy.classify_diseases(s.catalogue()), "id", {
        "risk_level": (7, F.lit(6)), "infection_score": (11, -0.5), "policy_profile": (13, "none"), "disease_code": (17, " "), "name": (19, "")})
    lower = spoil(listed, "id", {"disease_code": (23, F.lower("disease_code"))})
    visits = spoil(s.visit().withColumns({"weight": F.lit(70.0), "height": F.lit(170.0), "marital_status": F.lit("single")}), "id", {
        "status": (7, "ill"), "marital_status": (11, ""), "weight": (13, 0.05), "height": (17, 251.0)})
    points = spoil(s.geodata(), "id", {"region_type": (7, "moon"), "latitude": (11, null), "longitude": (13, 181.0), "patient_id": (17, F.lit(-1).cast("long"))})
    clusters = spoil(s.geocluster(), "id", {"center_lat": (7, null), "center_long": (11, 180.1), "radius": (13, -1.0), "case_count": (17, F.lit(-1)), "risk_level": (19, F.lit(6))})
    reports_ = spoil(s.report(), "id", {
        "alert_level": (7, "none"), "status": (11, "open"), "analysis_period_end": (13, F.date_sub("analysis_period_start", 1)), "disease_id": (17, F.lit(99).cast("long")),
        "nearby_case_count": (19, F.lit(-1)), "current_case_count": (23, F.lit(-1)), "previous_case_count": (29, F.lit(-1))})
    bad = replace(t, patient=people, visit=visits, geodata=points, report=reports_)
    return quality.summarise({
        "users": quality.check_users(spoil(s.users().withColumn("role", F.lit("doctor")), "id", {"role": (7, "nurse")})),
        "hospital": quality.check_hospitals(spoil(s.hospital(), "id", {"hospital_lat": (7, float("nan")), "hospital_long": (11, 180.5)})),
        "patient": quality.check_patients(people, TODAY), "disease": quality.check_diseases(lower), "visit": quality.check_visits(bad),
        "geodata": quality.check_points(bad), "geocluster": quality.check_clusters(clusters), "report": quality.check_reports(bad),
    })


def duplicate_keys(s: StarSchemaSource) -> DataFrame:
    return quality.duplicates(s.tables(), s.catalogue())


def geodata_derivation(s: StarSchemaSource) -> DataFrame:
    visits = s._read("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("patient_id"))
    return load.derive_points(visits, s.patient(), s.geodata())


def upsert_diseases(s: StarSchemaSource) -> DataFrame:
    listed = policy.classify_diseases(s.catalogue()).drop("is_reference", "source_name", "symptoms")
    incoming = load.last_row_wins(listed.withColumn("row_number", F.col("id")).drop("id"), ["disease_code"], "row_number")
    return load.upsert(s.disease(), incoming, ["disease_code"])


def fk_missing(s: StarSchemaSource) -> DataFrame:
    incoming = s._read("lineitem").select(
        F.col("l_partkey").alias("patient_id"), F.col("l_suppkey").alias("doctor_id"),
        F.col("l_linenumber").cast("long").alias("disease_id"),
    )
    return load.missing_references(incoming, s.tables())


def _file_of(s: StarSchemaSource, rows: DataFrame, name: str, sep: str = ",") -> str:
    """The rows as CSV files in the order of ``key``, every field quoted."""
    path = f"{shared_dir(s.spark)}/{name}-{uuid.uuid4().hex}.csv"
    texts = [F.col(c).cast("string").alias(c) for c in rows.columns if c != "key"]
    rows.orderBy("key").select(*texts).write.csv(path, header=True, sep=sep, quoteAll=True, escape='"', emptyValue="", nullValue="")
    return path


def _loaded(loaded: load.Loaded) -> DataFrame:
    """Accepted rows as one text and refused rows with their reason, by position in the file."""
    fields = [c for c in loaded.good.columns if c != "row_number"]
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in fields])
    good = loaded.good.select("row_number", F.lit(True).alias("accepted"), text.alias("content"))
    return good.unionByName(loaded.bad.select("row_number", F.lit(False).alias("accepted"), F.col("reason").alias("content")))


def _case(key, cases: dict[int, str], other):  # noqa: ANN001, ANN202
    """``cases``: the value where the key is a multiple of the number, the first that fits."""
    out = other if not isinstance(other, str) else F.lit(other)
    for n, value in reversed(cases.items()):
        out = F.when(key % n == 0, F.lit(value)).otherwise(out)
    return out


def import_hospitals(s: StarSchemaSource) -> DataFrame:
    """Suppliers as a file of hospitals with quotes, line breaks, missing names and bad coordinates."""
    key = F.col("s_suppkey")
    rows = s._read("supplier").select(
        key.alias("key"), _case(key, {4: ""}, F.format_string(' Clinic "%d", north\nwing ', key)).alias("name"),
        _case(key, {9: "north", 10: "", 11: "95.5"}, (key % 90).cast("double").cast("string")).alias("latitude"),
        F.lit("36.25").alias("longitude"), F.concat(F.lit("  street "), key.cast("string")).alias("location"), F.lit(" town").alias("city"))
    return _loaded(load.clean_hospitals(load.read_csv(s.spark, _file_of(s, rows, "hospitals"), imports.HEADERS["hospitals"])))


def import_users(s: StarSchemaSource) -> DataFrame:
    key = F.col("c_custkey")
    rows = s._read("customer").select(
        key.alias("key"), _case(key, {13: "x1"}, key.cast("string")).alias("id"), F.format_string("user%d", key).alias("username"),
        F.format_string(" u%d@example.org ", key).alias("email"), F.lit("A").alias("first_name"), F.lit("B, C").alias("last_name"),
        F.lit('say "hi"').alias("real_name"), F.lit("0123456789012345678901").alias("phon_number"),
        _case(key, {7: "nurse", 5: "", 3: " admin "}, "doctor").alias("role"), F.lit("secret").alias("password"))
    return _loaded(load.clean_users(load.read_csv(s.spark, _file_of(s, rows, "users"), imports.HEADERS["users"])))


def import_doctors(s: StarSchemaSource) -> DataFrame:
    """Parts as doctors; hospitals 0 to 24 are known, others are replaced by one of them."""
    key = F.col("p_partkey")
    rows = s._read("part").select(
        key.alias("key"), key.cast("string").alias("id"), _case(key, {17: " "}, (key * 2).cast("string")).alias("user_id"),
        F.col("p_size").cast("string").alias("hospital_id"), F.lit(" Internal\tMedicine ").alias("specialization"))
    loaded = load.clean_doctors(load.read_csv(s.spark, _file_of(s, rows, "doctors"), imports.HEADERS["doctors"]), s.hospital(), 1, 20)
    known = F.when(F.col("hospital_id").between(1, 20), "preferred").when(F.col("hospital_id").between(0, 24), "known").otherwise("unknown")
    return _loaded(load.Loaded(loaded.good.withColumn("hospital_id", known), loaded.bad))


def import_patients(s: StarSchemaSource) -> DataFrame:
    key = F.col("c_custkey")
    rows = s._read("customer").select(
        key.alias("key"), key.cast("string").alias("id"), F.concat(F.lit(" "), F.col("c_name")).alias("national_number"),
        F.format_string('"%d"\n, last', key).alias("name"), _case(key, {8: "31/12/1980", 9: ""}, "1980-12-31").alias("birth_date"),
        _case(key, {6: "other", 5: " FEMALE"}, "male").alias("gender"),
        _case(key, {7: "91", 4: " "}, "33.5").alias("residence_lat"), _case(key, {4: ""}, "36.5").alias("residence_long"),
        _case(key, {11: "east"}, "33.25").alias("work_lat"), _case(key, {10: "-181"}, "36.25").alias("work_long"))
    return _loaded(load.clean_patients(load.read_csv(s.spark, _file_of(s, rows, "patients"), imports.HEADERS["patients"])))


def import_visits(s: StarSchemaSource) -> DataFrame:
    key = F.col("o_orderkey")
    rows = s._read("orders").select(
        key.alias("key"), key.cast("string").alias("id"), F.col("o_custkey").cast("string").alias("patient_id"),
        _case(key, {19: "d1"}, "3").alias("doctor_id"), (key % 5 + 1).cast("string").alias("disease_id"),
        _case(key, {8: "2024-1-5", 9: "2024-02-30"}, " 2024-01-05 ").alias("diagnosis_date"), _case(key, {12: "ill", 5: " Cured "}, "infected").alias("status"),
        _case(key, {10: "", 11: "600"}, "70.5").alias("weight"), _case(key, {14: "29"}, "170").alias("height"),
        _case(key, {16: "?", 3: "Widow(er)", 2: "Divorce"}, "single").alias("marital_status"))
    return _loaded(load.clean_visits(load.read_csv(s.spark, _file_of(s, rows, "visits"), imports.HEADERS["visits"])))


def import_diseases(s: StarSchemaSource) -> DataFrame:
    """The catalogue as a file of reference diseases, with blanks for numbers and spaces around codes."""
    key = F.col("p_partkey")
    rows = s._read("part").select(
        key.alias("key"), _case(key, {5: ""}, key.cast("string")).alias("id"), F.format_string(" x%d ", key).alias("disease_code"),
        F.format_string(' Fever; "%d" ', key).alias("name"), F.lit("viral ").alias("type"), F.lit("airborne").alias("transmission_vector"),
        F.lit("a\nb").alias("symptoms"), _case(key, {3: " "}, (key % 6).cast("string")).alias("risk_level"),
        _case(key, {4: ""}, "0.5").alias("infection_score"))
    return load.load_diseases(s.spark, _file_of(s, rows, "diseases", ";"), " listed ").select(
        "row_number", "disease_code", "name", "type", "symptoms", "risk_level", "infection_score", "source_record_id", "source_name")


def visit_import_plan(s: StarSchemaSource) -> DataFrame:
    incoming = s._read("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("patient_id"))
    return load.dry_run(load.plan_visits(incoming, s.visit(), replay_existing=True))


def hospital_repair(s: StarSchemaSource) -> DataFrame:
    """Doctors whose hospital is unknown get one of the known hospitals."""
    doctors = s._read("part").select(
        F.col("p_partkey").alias("id"), F.col("p_partkey").alias("user_id"),
        F.col("p_type").alias("specialization"), F.col("p_size").cast("long").alias("hospital_id"),
    )
    fixed = load.repair_hospitals(doctors, s.hospital(), 1, 65)
    known = s.hospital().select(F.col("id").alias("hospital_id"), F.lit(True).alias("known"))
    return fixed.join(known, "hospital_id", "left").groupBy("known").agg(F.count(F.lit(1)).alias("doctors"))


LEGACY_WORDS = ["F", " Female ", "m", "أنثى", "Recovered", "شفاء", "office", "عمل", "Widow(er)", "متزوج", "divorced", ""]


def value_fixes(s: StarSchemaSource) -> DataFrame:
    words = F.array(*[F.lit(w) for w in LEGACY_WORDS])
    raw = s._read("customer").select(
        F.col("c_custkey").alias("id"), F.element_at(words, (F.col("c_custkey") % 12 + 1).cast("int")).alias("word"),
        F.lower("c_mktsegment").alias("segment"),
    )
    word = F.col("word")
    return raw.select(
        "id", fixes.fix_role(F.col("segment")).alias("role"), fixes.fix_gender(word).alias("gender"),
        fixes.fix_status(word).alias("status"), fixes.fix_region(word).alias("region_type"),
        fixes.fix_marital(word).alias("marital_status"), clinical.clean_text(word, 3).alias("short_word"),
        load.import_marital(word).alias("imported_marital"), clinical.to_bool(F.col("id")).alias("truth"),
    )


def merge_histories(s: StarSchemaSource) -> DataFrame:
    histories = s._read("customer").select(
        F.col("c_custkey").alias("id"), F.floor(F.col("c_custkey") / 3).alias("patient_id"),
        (F.col("c_acctbal") > 9000).alias("has_surgical_metal_plates"),
    )
    vaccines = s._read("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("history_id"))
    merged, id_map = fixes.merge_histories(histories)
    counts_ = fixes.repoint(vaccines, id_map).groupBy(F.col("history_id").alias("id")).agg(
        F.count(F.lit(1)).alias("vaccines")
    )
    return merged.join(counts_, "id", "left").select(
        "id", "patient_id", "has_surgical_metal_plates", F.coalesce("vaccines", F.lit(0)).alias("vaccines")
    )


def visit_level_dataset(t: Tables) -> DataFrame:
    return datasets.visit_level(t)


def disease_region_day_dataset(t: Tables) -> DataFrame:
    return datasets.disease_region_day(t)


def risk_features(t: Tables) -> DataFrame:
    return risk.visit_features(t)


def risk_labels(t: Tables) -> DataFrame:
    return risk.visit_labels(t, active.active_visits(t.visit))


def risk_centroids(t: Tables) -> DataFrame:
    return risk.centroid_rows(risk.train_centroids(risk.training_samples(t)))


def risk_predictions(t: Tables) -> DataFrame:
    artifact = risk.train_centroids(risk.training_samples(t))
    return risk.predict_centroids(t, risk.visit_features(t), artifact).drop("class_distances")


def label_counts(t: Tables) -> DataFrame:
    """Training labels by where they come from."""
    artifact = risk.train_centroids(risk.training_samples(t))
    source = F.explode(F.array(*[F.struct(F.lit(n).alias("label_source"), F.col(f"from_{n}").alias("samples")) for n in ("report", "engine", "default")]))
    return artifact.select("label", source.alias("s")).select("label", "s.*").filter("samples > 0")


def stored_centroids(t: Tables) -> DataFrame:
    """The risk model after it was written and read back."""
    path = f"{shared_dir(t.visit.sparkSession)}/risk-model-{uuid.uuid4().hex}"
    sinks.save_centroids(risk.require_trainable(risk.train_centroids(risk.training_samples(t))), path)
    return risk.centroid_rows(sinks.load_centroids(t.visit.sparkSession, path))


def exported_visits(t: Tables) -> DataFrame:
    """The visit file of the training export, read back; blanks stand for nulls."""
    spark, folder = t.visit.sparkSession, f"{shared_dir(t.visit.sparkSession)}/export-{uuid.uuid4().hex}"
    written = {r["dataset"]: r["path"] for r in sinks.export_datasets(t, folder).collect()}
    return spark.read.csv(written["visit_level_dataset"], header=True).select(
        "visit_id", "diagnosis_date", "patient_id", "disease_code", "patient_age_years", "primary_region_type", "latest_report_alert_level",
        "total_lab_test_count", "has_active_alert")


def geojson_features(t: Tables) -> DataFrame:
    """The map features as written to text, read back and parsed."""
    spark, path = t.visit.sparkSession, f"{shared_dir(t.visit.sparkSession)}/features-{uuid.uuid4().hex}"
    sinks.write_features(filters.map_cases(t), path)
    shape = "type string, id long, geometry struct<type:string,coordinates:array<double>>, properties struct<id:long,visit_id:long,disease_code:string,region_type:string,latitude:double>"
    read = spark.read.text(path).select(F.from_json("value", shape).alias("f"))
    return read.select(
        F.col("f.id").alias("geodata_id"), F.col("f.type").alias("kind"), F.col("f.geometry.type").alias("shape"),
        F.col("f.geometry.coordinates")[0].alias("longitude"), F.col("f.geometry.coordinates")[1].alias("latitude"),
        F.col("f.properties.id").alias("property_id"), F.col("f.properties.visit_id").alias("visit_id"),
        F.col("f.properties.disease_code").alias("disease_code"), F.col("f.properties.region_type").alias("region_type"),
        F.col("f.properties.latitude").alias("latitude_property"))


def forest_samples(t: Tables) -> DataFrame:
    return forest.report_samples(t)


def forest_predictions(t: Tables) -> DataFrame:
    samples = forest.report_samples(t)
    model, _ = forest.train_forest(samples)
    return forest.predict_forest(samples, model).select("report_id", "label", "ml_alert_level", "ml_confidence")


def outbreak_with_forest(t: Tables) -> DataFrame:
    model, _ = forest.train_forest(forest.report_samples(t))
    return outbreak.evaluate_outbreaks(
        t, outbreak.contexts_of(t), policy.alert_policies(t.disease), predict=forest.predictor(t, model)
    ).select("geodata_id", "alert_level", "score", "decision_source")


def _recent_clusters(t: Tables) -> DataFrame:
    return dbscan.dbscan(active.collect_points(t, lookback_days=14), eps_km=1.0, min_samples=3)


def dbscan_labels(t: Tables) -> DataFrame:
    return _recent_clusters(t).select("geodata_id", "disease_id", "cluster_id")


def dbscan_summary(t: Tables) -> DataFrame:
    summary = dbscan.summarise_clusters(_recent_clusters(t), t)
    return summary.withColumn("region_types", F.array_join("region_types", ","))


AS_OF = datetime(2024, 1, 31)


def hotspot_merge(t: Tables) -> DataFrame:
    summary = jobs.cut_lineage(dbscan.summarise_clusters(_recent_clusters(t), t))
    return hotspots.merge_hotspots(hotspots.candidates_from_clusters(summary), t.geocluster, AS_OF)


def report_merge(t: Tables) -> DataFrame:
    """A monitoring run over all points, merged into the stored alert table."""
    analyses = jobs.cut_lineage(
        outbreak.evaluate_outbreaks(t, outbreak.contexts_of(t), policy.alert_policies(t.disease))
    )
    return report_upkeep.merge_reports(t, analyses, t.report, AS_OF).drop("reasons", "summary")


def cluster_from_analysis(t: Tables) -> DataFrame:
    policies = policy.alert_policies(t.disease)
    analyses = jobs.cut_lineage(outbreak.evaluate_outbreaks(t, outbreak.contexts_of(t), policies))
    nearby = spatial.nearby_cases(t, analyses.filter("should_create_cluster"), policies, spread=True)
    found = hotspots.clusters_from_analyses(t, analyses, nearby)
    # Sums of many doubles differ in their last digits with the order of the rows.
    return found.withColumns({"center_lat": F.round("center_lat", 6), "center_long": F.round("center_long", 6), "radius_km": F.round("radius_km", 4)})


def hdbscan_summary(t: Tables) -> DataFrame:
    points = active.collect_points(t, lookback_days=14)
    labelled = hdbscan.hdbscan(points, min_cluster_size=3)
    return dbscan.summarise_clusters(labelled.filter("cluster_id is not null"), t)


def _stream_visits(s: StarSchemaSource) -> DataFrame:
    return s.visit(s.event_stream(), F.lit(s._read("supplier").count()))


def case_events(s: StarSchemaSource) -> DataFrame:
    """All saved points as a stream of changes, through keyed state, into an event table."""
    visits = _stream_visits(s)
    carried = ("disease_id", "doctor_id", "diagnosis_date", "status")
    points = s.geodata(visits, keep=carried)
    changes = points.select(
        F.col("id").alias("seq"), F.lit("geodata").alias("kind"), F.lit(True).alias("created"),
        "visit_id", "patient_id", *carried, F.col("id").alias("geodata_id"), "region_type",
        "latitude", "longitude",
    )
    out = feed.run_to_table(changes, f"{shared_dir(s.spark)}/case-events-{uuid.uuid4().hex}")
    return out.select("seq", "event_type", "geodata_id", "visit_id", "patient_id", "disease_id", "status")


def case_event_routing(s: StarSchemaSource) -> DataFrame:
    """Events per subscriber group and type, for one hospital's subscribers."""
    described = feed.describe(case_events_full(s), s.tables())
    seen = feed.for_subscriber(described, hospital_id=HOSPITAL, start=date(2024, 1, 10))
    return feed.route(seen).groupBy("group_name", "event_type").agg(F.count(F.lit(1)).alias("events"))


def case_events_full(s: StarSchemaSource) -> DataFrame:
    """The same feed computed on stored points; used where no stream is needed."""
    changes = feed.changes_from_points(s.geodata(), s.visit())
    return feed.events_of_saved_points(changes)


def monitor_stream(s: StarSchemaSource) -> DataFrame:
    """Saved points as a stream over the stored tables: each micro-batch writes new alert and hotspot versions.

    The points of the first half of the month arrive before those of the second, so there are two batches.
    """
    base = f"{shared_dir(s.spark)}/monitor-{uuid.uuid4().hex}"
    points = s.geodata(s.visit(), keep=("diagnosis_date",))
    early = F.col("diagnosis_date") < F.lit(date(2024, 1, 16))
    for arrived in (early, ~early):
        points.filter(arrived).drop("diagnosis_date").write.mode("append").parquet(f"{base}/points")
        stream = s.spark.readStream.schema(SCHEMAS["geodata"]).parquet(f"{base}/points")
        monitoring.start_monitoring(stream, s.tables, base, lambda: AS_OF, f"{base}/checkpoint", start=s.tables()).awaitTermination()
    tables = {n: monitoring.VersionedTable(s.spark, base, n) for n in ("report", "geocluster")}
    newest = {n: v.before(v.versions()[-1] + 1).withColumn("table_name", F.lit(n)) for n, v in tables.items()}
    return newest["report"].drop("reasons", "summary").unionByName(newest["geocluster"], allowMissingColumns=True)


def queries() -> dict[str, Query]:
    on_tables = [
        hotspot_merge, report_merge, cluster_from_analysis, hdbscan_summary,
        dbscan_labels, dbscan_summary,
        visit_level_dataset, disease_region_day_dataset, risk_features, risk_labels,
        risk_centroids, risk_predictions, label_counts, stored_centroids, exported_visits, geojson_features, forest_samples, forest_predictions, outbreak_with_forest,
        active_visits_global, active_visits_window, visit_activity, active_points_case_mode,
        active_point_list, map_active_cases, map_page, map_historical_cases, map_hospital_cases,
        patient_scope, hospital_scope, active_alerts, active_hotspots, patient_history,
        visit_page, generated_reports, anomalies, trend_snapshots, trend_snapshots_by_region,
        nearby_cases, outbreak_evaluation, exposure_evaluation, visit_evaluation, outbreak_texts, anomaly_texts, report_texts,
        counts.cases_by_disease, counts.cases_over_time, counts.cases_by_doctor,
        counts.cases_by_region_type, counts.disease_region_matrix, counts.alerts_by_disease,
        counts.dashboard_summary,
    ]
    on_source = [
        disease_classification, alert_policies, dq_violations, dq_every_rule, duplicate_keys, geodata_derivation,
        case_events, case_event_routing, monitor_stream, upsert_diseases, fk_missing, import_hospitals, import_users, import_doctors, import_patients, import_visits, import_diseases, visit_import_plan, hospital_repair, value_fixes, merge_histories,
    ]
    return {
        **{f.__name__: _on_tables(f) for f in on_tables},
        **{f.__name__: _on_source(f) for f in on_source},
    }
