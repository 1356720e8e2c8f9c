"""Imports, fixes, quality checks, datasets, models and the change stream."""

import csv
import io
import json
import random
import uuid
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import compare, connect
from epiwake.operators import datasets, filters, forest, quality, risk
from epiwake.plans import catalog, imports
from epiwake.session import shared_dir
from epiwake.sources import load, sinks
from epiwake.streaming import case_events as feed
from world import D, World, base, rows

HEADER = "id;disease_code;name;type;transmission_vector;symptoms;risk_level;infection_score\n"


def write(tmp_path, name, text, encoding="utf-8"):
    path = tmp_path / name
    path.write_text(text, encoding=encoding)
    return str(path)


def test_disease_import_and_upsert(spark, tmp_path):
    first = write(tmp_path, "a.csv", HEADER + "1;1a00;Cholera;gastrointestinal;waterborne;;4;0.8\n2;1F03;Measles;epidemic_infectious;airborne;;;\n", "utf-8-sig")
    got = load.load_diseases(spark, first)
    assert rows(got, "disease_code", "policy_profile", "risk_level", "source_record_id") == [("1A00", "cluster_sensitive", 4, 1), ("1F03", "high_priority", 0, 2)]
    again = load.load_diseases(spark, write(tmp_path, "b.csv", HEADER + "1;1A00;Cholera new;x;y;;4;0.8\n1;1A00;Cholera last;x;y;;4;0.8\n"))
    merged = load.upsert(got.drop("row_number"), load.last_row_wins(again, ["disease_code"], "row_number"), ["disease_code"])
    assert rows(merged, "disease_code", "name", "change") == [("1A00", "Cholera last", "updated"), ("1F03", "Measles", "kept")]
    for bad in ("1;;x;;;;1;1\n", "1;A;x;;;;one;1\n"):
        with pytest.raises(load.ImportFailed):
            load.load_diseases(spark, write(tmp_path, f"{uuid.uuid4().hex}.csv", HEADER + bad))
    with pytest.raises(load.ImportFailed):
        load.load_diseases(spark, write(tmp_path, "c.csv", "id;name\n1;x\n"))


def test_visit_import(spark, tmp_path):
    text = "id,patient_id,doctor_id,disease_id,diagnosis_date,status,weight,height,marital_status\n"
    text += "1,1,1,1,2026-04-01, Infected ,70,170,Widow(er)\n2,1,1,1,04/01/2026,infected,70,170,single\n3,9,1,1,2026-04-02,cured,,170,single\n7,9,1,1,2026-04-02,cured,70,170,divorce\n"
    raw = load.read_csv(spark, write(tmp_path, "v.csv", text), ["id", "patient_id"])
    got = load.clean_visits(raw)
    assert rows(got.good, "id", "status", "marital_status") == [(1, "infected", "widow"), (7, "cured", "divorced")]
    assert rows(got.bad, "row_number") == [(2,), (3,)]
    t = base().tables(spark)
    assert rows(load.missing_references(got.good, t), "reference", "missing_id") == [("patient_id", 9)]
    with pytest.raises(load.ImportFailed):
        load.require_references(got.good, t)
    assert rows(load.dry_run(load.plan_visits(got.good, t.visit)), "action", "visits") == [("insert", 1), ("replay", 0), ("skip", 1)]
    assert load.stop_after(raw, 2).count() == 2


def test_quality_flags(spark):
    w = World().visit(1, 1, 1, "1980-01-01", "ill", points=[(95.0, 36.0, "moon")])
    w.report(1, 2, "high", 5, "new", start="2026-04-03", end="2026-04-01", trigger=1)
    t = w.tables(spark)
    found = {(r["table_name"], r["rule"]) for r in quality.summarise(quality.check_all(t, date(1985, 1, 1))).collect()}
    assert found == {("visit", "status"), ("visit", "before_birth"), ("geodata", "latitude"), ("geodata", "region_type"),
                     ("report", "period"), ("report", "trigger_visit"), ("patient", "birth_date")}


def test_datasets_and_map_document(spark, tmp_path):
    w = base().report(1, 1, "high", 55, "new", trigger=1).cluster(1, 1, 33.5, 36.2, 1.0, 3, 4)
    w.lab(1, 1, "Abnormal high WBC").lab(2, 3, "Normal")
    t = w.tables(spark)
    visit = datasets.visit_level(t).filter("visit_id = 1").first()
    assert [visit[c] for c in ("primary_region_type", "has_home_geodata", "total_lab_test_count", "abnormal_lab_test_count", "has_active_alert")] == ["home", 1, 1, 1, 1]
    day = datasets.disease_region_day(t).filter("disease_code = 'MEA' and region_type = 'home'").first()
    assert [day[c] for c in ("visit_count", "unique_patient_count", "total_lab_test_count", "abnormal_lab_test_count", "active_report_count", "high_alert_count", "active_hotspot_count")] == [1] * 7
    written = {r["dataset"]: r["row_count"] for r in sinks.export_datasets(t, str(tmp_path)).collect()}
    assert written == {"visit_level_dataset": 3, "disease_region_day_dataset": 3}
    document = json.loads(sinks.feature_collection(filters.map_cases(t)).first()["document"])
    assert document["count"] == 3 and document["features"][0]["geometry"]["coordinates"] == [36.2501, 33.5001]
    assert "latitude" not in document["features"][0]["properties"]


def test_models(spark, tmp_path):
    w = World()
    for i in range(1, 13):
        level = ["low", "critical", "medium"][i % 3]
        w.visit(i, i, {"low": 4, "critical": 3, "medium": 2}[level], "2026-04-05", points=[(33 + i / 10, 36, "home")])
        w.report(i, {"low": 4, "critical": 3, "medium": 2}[level], level, {"low": 5, "critical": 95, "medium": 40}[level], "new", trigger=i)
    t = w.tables(spark)
    artifact = risk.require_trainable(risk.train_centroids(risk.training_samples(t)))
    sinks.save_centroids(artifact, str(tmp_path / "risk"))
    stored = sinks.load_centroids(spark, str(tmp_path / "risk"))
    predicted = {r["visit_id"]: (r["predicted_label"], r["confidence"]) for r in risk.predict_centroids(t, risk.visit_features(t), stored).collect()}
    assert predicted[1][0] == "critical" and predicted[1][1] > 0 and predicted[3][0] == "low"
    with pytest.raises(FileNotFoundError):
        sinks.load_centroids(spark, str(tmp_path / "none"))
    model, meta = forest.train_forest(forest.report_samples(t), trees=10)
    forest.save_forest(spark, model, meta, str(tmp_path / "forest"))
    model, meta = forest.load_forest(spark, str(tmp_path / "forest"))
    got = forest.predict_forest(forest.report_samples(t), model)
    assert got.filter("label = ml_alert_level").count() == 12 and meta["sample_count"] == 12
    assert got.select(F.sum(F.aggregate(F.map_values("ml_probabilities"), F.lit(0.0), lambda a, b: a + b)).alias("s")).first()["s"] == pytest.approx(12, abs=0.01)


def test_change_stream(spark):
    def change(seq, kind, created, visit, day, status, point=None, patient=1):
        return (seq, kind, created, visit, patient, 1, 1, D(day), status, point, "home" if point else None, 33.5 if point else None, 36.2 if point else None)

    changes = [
        change(1, "geodata", True, 1, "2026-04-05", "infected", 11),
        change(2, "geodata", True, 2, "2026-04-01", "infected", 12),   # late and older: never live
        change(3, "geodata", True, 3, "2026-04-09", "infected", 13),   # newer: the others go
        change(4, "visit", False, 3, "2026-04-09", "cured"),
        change(5, "geodata", False, 3, "2026-04-09", "infected", 13),
    ]
    folder = f"{shared_dir(spark)}/changes-{uuid.uuid4().hex}"
    spark.createDataFrame(changes, feed.CHANGE_SCHEMA).coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(feed.CHANGE_SCHEMA).parquet(folder)
    events = feed.run_to_table(stream, folder + "-out", state_partitions=2)
    assert rows(events, "seq", "geodata_id", "event_type") == [
        (1, 11, feed.ADDED), (2, 12, feed.REMOVED), (3, 11, feed.REMOVED), (3, 12, feed.REMOVED), (3, 13, feed.ADDED),
        (4, 11, feed.REMOVED), (4, 12, feed.REMOVED), (4, 13, feed.REMOVED),
        (5, 11, feed.REMOVED), (5, 12, feed.REMOVED), (5, 13, feed.UPDATED),
    ]
    described = feed.describe(events, base().tables(spark))
    assert feed.for_subscriber(described, disease_type="Viral").count() == 0
    assert {r["group_name"] for r in feed.route(described).select("group_name").distinct().collect()} == {"map.active.all", "map.active.disease.MEA", "map.active.type.viral"}


def test_pairs_share_state_calls():
    """A micro-batch of many pairs makes a few calls to the state, and later batches see what it held."""
    import pandas as pd

    class Held:
        def __init__(self):
            self.rows, self.calls = [], 0

        def exists(self):
            self.calls += 1
            return bool(self.rows)

        def get(self):
            self.calls += 1
            return iter(self.rows)

        def appendList(self, rows):
            self.calls += 1
            self.rows = self.rows + list(rows)

        def put(self, rows):
            self.calls += 1
            self.rows = list(rows)

    class Handle:
        def __init__(self):
            self.lists = {}

        def getListState(self, name, schema):
            return self.lists.setdefault(name, Held())

    def change(seq, patient, visit, day, kind="geodata", created=True):
        return (seq, kind, created, visit, patient, 1, 7, date(2026, 4, day), "infected", seq if kind == "geodata" else None, "home", 33.5, 36.25)

    names = [f.strip().split(" ")[0] for f in feed.CHANGE_SCHEMA.split(",")]
    handle, state = Handle(), feed.CaseState()
    state.init(handle)
    first = pd.DataFrame([change(p, p, p, 2) for p in range(1, 61)], columns=names)
    events = pd.concat(state.handleInputRows((1, 0), iter([first]), None))
    assert list(events["event_type"]) == [feed.ADDED] * 60 and sum(h.calls for h in handle.lists.values()) <= 4
    for day in (3, 4):
        again = pd.DataFrame([change(200 * day + p, p, 100 * day + p, day) for p in range(1, 61, 2)] + [change(200 * day + 90, 2, 2, 2, "visit", False)], columns=names)
        events = pd.concat(state.handleInputRows((1, 0), iter([again]), None))
        assert (events["event_type"] == feed.ADDED).sum() == 30 and (events["event_type"] == feed.REMOVED).sum() == 30 * (day - 2)
        assert list(events[events["event_type"] == feed.UPDATED]["geodata_id"]) == [2]
    for _ in range(200):
        list(state.handleInputRows((1, 0), iter([again.tail(1)]), None))
    assert len(handle.lists["visits"].rows) <= 2 * 120


@pytest.mark.parametrize("name", ["cases_by_disease", "active_visits_window", "anomalies", "outbreak_evaluation", "visit_level_dataset"])
def test_registered_query_equals_sql(spark, name):
    folder = entry.SMOKE_DIR
    assert compare(spark, connect(folder), folder, name, entry.queries()[name], entry.oracle_sql()[name]) in (None, "no rows")


def test_every_sql_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert datetime(2026, 1, 1)


def test_csv_fields_with_quotes_and_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n1,"say ""x, y"" now"\n2,"two\nlines"\n3,plain\n', encoding="utf-8")
    rows = load.read_csv(spark, str(tmp_path / "a.csv"), ["id", "name"]).orderBy("row_number").collect()
    assert [(r.row_number, r.id, r.name) for r in rows] == [(1, "1", 'say "x, y" now'), (2, "2", "two\nlines"), (3, "3", "plain")]


@pytest.mark.parametrize("block, line_end", [(37, "\n"), (64, "\r\n"), (1 << 20, "\n")])
def test_csv_blocks_equal_a_plain_reader(spark, tmp_path, block, line_end):
    """Quoted line breaks across block borders, several files, empty lines: as the standard reader in file order."""
    rng = random.Random(block)
    expected = []
    for name in ("b.csv", "a.csv", "c.csv"):
        out = io.StringIO()
        writer = csv.writer(out, lineterminator=line_end)
        writer.writerow(["id", "na me", "note"])
        for k in range(rng.randint(0, 60)):
            writer.writerow([k, rng.choice(["plain", 'say "x, y"', "", " sp "]), "".join(rng.choice(["a", "é", "\n", '"', ",", "\n\n", "x" * 30]) for _ in range(rng.randint(0, 8)))])
            if rng.random() < 0.1:
                out.write(line_end)
        (tmp_path / name).write_bytes(out.getvalue().encode())
    for name in ("a.csv", "b.csv", "c.csv"):
        text = (tmp_path / name).read_bytes().decode()
        expected += [tuple(r.values()) for r in csv.DictReader(io.StringIO(text, newline=""))]
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        read = load.read_csv(spark, str(tmp_path), ["id", "note"])
        got = [tuple(r) for r in read.orderBy("row_number").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [g[3] for g in got] == list(range(1, len(expected) + 1))
    assert [tuple(x or "" for x in g[:3]) for g in got] == expected


def test_csv_lines_are_not_shuffled(spark, tmp_path):
    """Blocks are numbered where they are read: no window over lines, and only records over several lines move."""
    (tmp_path / "a.csv").write_text('id,name\n1,x\n2,"two\nlines"\n\n3,y\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("\n\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("id,name\n4,z\n", encoding="utf-8")
    records = load.csv_records(spark, str(tmp_path))
    assert [r.record for r in records.orderBy("row_number").collect()] == ["1,x", '2,"two\nlines"', "3,y", "4,z"]
    assert sorted(r.row_number for r in records.collect()) == [1, 2, 3, 4]
    plan = load.csv_records(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and not any("value#" in line for line in plan.split("\n") if "Window [" in line)


def test_records_are_parsed_once(spark, tmp_path):
    # The filters of good and bad rows parsed a record again for each field that a rule names.
    lines = ["id,patient_id,doctor_id,disease_id,diagnosis_date,status,weight,height,marital_status", "1,1,1,1,2024-01-05,infected,70,170,single", "x,1,1,1,2024-01-05,ill,70,170,single"]
    loaded = load.clean_visits(load.read_csv(spark, write(tmp_path, "v.csv", "\n".join(lines)), imports.HEADERS["visits"]))
    for part, n in ((loaded.good, 1), (loaded.bad, 1)):
        assert "from_csv" not in part._jdf.queryExecution().executedPlan().toString() and part.count() == n
    assert loaded.bad.first()["reason"] == "id is not a number; status is not in the domain"


def test_forest_rows_are_dealt_to_tasks(spark, monkeypatch):
    fitted, vector = [], forest._vector
    monkeypatch.setattr(forest, "_vector", lambda df: fitted.append(df.rdd.getNumPartitions()) or vector(df))
    monkeypatch.setattr(forest, "TASK_ROWS", 5, raising=False)
    columns = ["report_id", "label", *forest.FEATURES]
    rows = spark.createDataFrame([(k, forest.LABELS[k % 2], *[float(k % 7)] * len(forest.FEATURES)) for k in range(40)], columns)
    model, meta = forest.train_forest(rows.coalesce(1), trees=2, max_depth=2)
    assert meta["sample_count"] == 40 and fitted == [8]


def test_forest_tasks_are_as_many_as_cores():
    # Each task sends on a table of all nodes, so a task per 100,000 rows made the tables grow with the rows.
    assert [forest._tasks(n, 8) for n in (1, 100_000, 100_001, 900_000, 8_000_000, 9_000_000)] == [1, 1, 2, 8, 8, 16]


def test_import_job_from_files_to_reports(spark, tmp_path):
    from dataclasses import replace

    texts = {
        "hospitals": "name,latitude,longitude,location,city\n,33.5,36.2,a,b\nNorth,x,36.2,a,b\n",
        "users": "id,username,email,first_name,last_name,real_name,phon_number,role\n900,u,u@e.org,A,B,C,1,doctor\n901,v,,A,B,C,1,nurse\n",
        "doctors": "id,user_id,hospital_id,specialization\n900,900,77,x\n",
        "patients": "id,national_number,name,birth_date,gender,residence_lat,residence_long,work_lat,work_long\n"
                    + "".join(f"{p},n{p},\"P, {p}\",1990-01-01,male,33.5{p - 900},36.25,,\n" for p in range(901, 905)) + "905,n,P,?,male,,,,\n901,n901b,Last,1990-01-01,female,33.51,36.25,,\n",
        "visits": "id,patient_id,doctor_id,disease_id,diagnosis_date,status,weight,height,marital_status\n"
                  + "".join(f"{700 + p},{p},900,1,2026-04-1{p - 900},infected,70,170,single\n" for p in range(901, 905)) + "1,901,900,1,2026-04-11,infected,70,170,single\n",
    }
    paths = {group: write(tmp_path, f"{group}.csv", text) for group, text in texts.items()}
    before = base().report(5, 1, "low", 5, "resolved").cluster(3, 2, 10.0, 10.0, 1.0, 1, 1).tables(spark)
    before = replace(before, medical_history=spark.createDataFrame([(4, 901, True)], "id long, patient_id long, has_surgical_metal_plates boolean"))
    dry = imports.import_files(spark, paths, before, datetime(2026, 4, 20), dry_run=True, stop_after=4)
    assert dry.tables is before and ("visits", "insert", 4) in rows(dry.counts, "group", "action", "rows")
    done = imports.import_files(spark, paths, before, datetime(2026, 4, 20), replay_existing=True)
    assert rows(done.counts.filter("rows > 0"), "group", "action", "rows") == [
        ("doctors", "created", 1), ("hospitals", "refused", 1), ("hospitals", "updated", 1), ("patients", "created", 4), ("patients", "refused", 1),
        ("users", "created", 1), ("users", "refused", 1), ("visits", "insert", 4), ("visits", "replay", 1)]
    assert rows(done.refused["users"], "row_number") == [(2,)]
    t = done.tables
    assert rows(t.patient.filter("id = 901"), "name", "gender") == [("Last", "female")]
    assert t.visit.count() == before.visit.count() + 4 and t.geodata.count() == before.geodata.count() + 4
    assert rows(t.medical_history.filter("patient_id > 900"), "patient_id") == [(901,), (902,), (903,), (904,)]
    known = {r.id for r in before.report.collect()}
    assert {r.id for r in done.delta.filter("table_name = 'report'").collect()} == {r.id for r in t.report.collect()} - known != set()
    only = imports.import_files(spark, paths, before, datetime(2026, 4, 20), only={"users"})
    assert rows(only.counts, "group", "action") == [("users", "created"), ("users", "refused")] and only.delta.count() == 0


def test_forest_queries_train_the_whole_forest(spark, monkeypatch):
    w, models, train = World(), [], forest.train_forest
    w.visit(1, 1, 1, "2026-04-18", points=[(33.5, 36.25, "home")]).report(1, 1, "low", 5, "new").report(2, 1, "high", 70, "new")
    monkeypatch.setattr(forest, "train_forest", lambda *a, **k: models.append(train(*a, **k)) or models[-1])
    t = w.tables(spark)
    assert catalog.forest_predictions(t).count() == 2
    assert catalog.outbreak_with_forest(t).count() == 1
    assert [(m.getNumTrees, m.getMaxDepth(), meta["n_estimators"]) for m, meta in models] == [(100, 10, 100)] * 2
