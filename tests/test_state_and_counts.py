"""Active state, counts, filters, trends, anomalies and on-demand reports on small tables."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from epiwake.operators import active, anomaly, counts, filters, reports, trend
from world import D, World, base, rows


def test_counts_on_base_tables(spark):
    t = base().tables(spark)
    measles = filters.filter_visits(t.visit, disease=1)
    assert rows(counts.cases_over_time(t, measles), "diagnosis_date", "total_cases") == [(D("2026-04-01"), 2)]
    assert rows(counts.cases_by_doctor(t, measles), "doctor_id", "total_cases") == [(1, 1), (2, 1)]
    assert rows(counts.cases_by_region_type(t, measles, "home"), "region_type", "total_cases") == [("home", 1)]
    assert rows(counts.disease_region_matrix(t, measles, "home"), "disease_name", "region_type", "total_cases") == [("Measles", "home", 1)]


def test_map_feed(spark):
    t = base().tables(spark)
    assert filters.map_cases(t).count() == 3
    assert filters.map_cases(t, filters.MapFilter(disease_code="mea")).count() == 2
    assert filters.map_cases(t, filters.MapFilter(disease_type="viral")).count() == 2
    day = date(2026, 4, 2)
    past = filters.map_cases(t, filters.MapFilter(start_date=day, end_date=day), active=False)
    assert rows(past, "disease_code") == [("COL",)]
    with pytest.raises(ValueError):
        filters.MapFilter(start_date=date(2026, 4, 3), end_date=date(2026, 4, 1))
    with pytest.raises(ValueError):
        filters.MapFilter(limit=10001)


def test_later_cure_hides_infection(spark):
    w = World()
    w.visit(1, 1, 1, "2026-04-06").visit(2, 1, 1, "2026-04-09", "cured")
    w.visit(3, 2, 1, "2026-04-07").visit(4, 2, 1, "2026-04-10")
    w.visit(5, 3, 1, "2026-04-08").visit(6, 3, 2, "2026-04-09", "cured")
    t = w.tables(spark)
    assert rows(active.active_visits(t.visit), "id") == [(4,), (5,)]
    window = F.col("diagnosis_date") <= F.lit(date(2026, 4, 8))
    assert rows(active.active_visits(t.visit.filter(window)), "id") == [(1,), (3,), (5,)]
    assert rows(active.active_visits(t.visit, window), "id") == [(5,)]
    assert rows(active.flag_active(t.visit).filter("is_active"), "id") == [(4,), (5,)]


def test_point_modes(spark):
    w = World()
    day = "2026-04-15"
    w.visit(1, 1, 1, day, points=[(33.1, 36.1, "home")])
    w.visit(2, 2, 1, day, points=[(33.2, 36.2, "work")])
    w.visit(3, 3, 1, day, points=[(33.3, 36.3, "home"), (33.4, 36.4, "work")])
    w.visit(4, 4, 1, day)
    t = w.tables(spark)
    assert active.collect_points(t).count() == 4
    assert rows(active.collect_points(t, mode="case"), "geodata_id") == [(1,), (2,), (3,)]
    assert active.collect_points(t, region="work", mode="case").count() == 2
    with pytest.raises(ValueError):
        active.collect_points(t, mode="both")


def test_lookback_uses_newest_located_visit(spark):
    w = World()
    w.visit(1, 1, 1, "2026-04-01", points=[(33.1, 36.1, "home")])
    w.visit(2, 2, 1, "2026-04-10", "cured", points=[(33.1, 36.1, "home")])
    w.visit(3, 3, 1, "2026-05-30")
    t = w.tables(spark)
    assert active.collect_points(t, lookback_days=9).count() == 1
    assert active.collect_points(t, lookback_days=8).count() == 0
    assert active.collect_points(t, lookback_days=8, date_from=date(2026, 3, 1)).count() == 1


def test_trend_and_window_counts(spark):
    w = World()
    two = [(33.5, 36.2, "home"), (33.6, 36.3, "home")]
    w.visit(1, 1, 1, "2026-04-08", points=[(33.5, 36.2, "home")])
    w.visit(2, 2, 1, "2026-04-09", points=two)
    w.visit(3, 3, 1, "2026-04-10", points=[(33.5, 36.2, "work")])
    w.visit(4, 4, 1, "2026-04-02").visit(5, 5, 1, "2026-04-03")
    w.visit(6, 6, 2, "2026-04-02")
    t = w.tables(spark)
    windows = spark.createDataFrame([(1, D("2026-04-08"), D("2026-04-10"))], "disease_id long, start_date date, end_date date")
    assert rows(trend.count_cases(t, windows, "home"), "case_count") == [(2,)]
    pairs = spark.createDataFrame(
        [(1, D("2026-04-08"), D("2026-04-10"), D("2026-04-01"), D("2026-04-07")),
         (2, D("2026-04-02"), D("2026-04-03"), D("2026-03-25"), D("2026-03-31"))],
        "disease_id long, current_start date, current_end date, previous_start date, previous_end date",
    )
    got = rows(trend.trend(t, pairs), "disease_id", "current_count", "previous_count", "growth_rate", "surge_ratio")
    assert got == [(1, 3, 2, 0.5, 1.5), (2, 1, 0, 1.0, 1.0)]
    with pytest.raises(Exception):
        trend.count_cases(t, windows.select("disease_id", F.col("end_date").alias("start_date"), F.col("start_date").alias("end_date"))).collect()


def test_interval_series_equals_window_recount(spark):
    import random

    rng = random.Random(5)
    w = World()
    for i in range(1, 160):
        w.visit(i, rng.randint(1, 12), rng.randint(1, 2), f"2026-04-{rng.randint(1, 28):02d}", rng.choice(["infected", "cured"]))
    t = w.tables(spark)
    spans = spark.createDataFrame([(1, 3, 9), (2, 14, 4)], "disease_id long, lookback_days int, baseline_window_days int")
    got = {(r["disease_id"], r["diagnosis_date"]): (r["current_count"], r["previous_count"])
           for r in trend.trend_by_day(active.daily_states(t.visit), spans, t.visit).collect()}

    def recount(disease, start, end):
        latest = {}
        for v in sorted(w.visits, key=lambda v: (v[5], v[0])):
            if v[3] == disease and start <= v[5].toordinal() <= end:
                latest[v[1]] = v[6]
        return sum(s == "infected" for s in latest.values())

    for (disease, day), counted in got.items():
        back, base_days = {1: (3, 9), 2: (14, 4)}[disease]
        e = day.toordinal()
        assert counted == (recount(disease, e - back, e), recount(disease, e - back - 1 - base_days, e - back - 1))
    assert len(got) == len({(v[3], v[5]) for v in w.visits})


def test_anomaly_surge_found_and_stable_series_quiet(spark):
    w, home = World(), [(33.5, 36.2, "home")]
    for i, day in enumerate(["05", "06", "07", "08", "09", "09", "09", "09"], 1):
        w.visit(i, i, 2, f"2026-04-{day}", points=home)
    for i in range(5, 10):
        w.visit(100 + i, 100 + i, 4, f"2026-04-{i:02d}", points=home)
    for i in range(3):
        w.visit(200 + i, 200, 1, "2026-04-09", points=home)
    found = anomaly.detect_anomalies(w.tables(spark), lookback_days=14, baseline_window_days=4).collect()
    assert [(r["disease_code"], r["target_date"], r["observed_count"], r["anomaly_score"], r["severity"]) for r in found] == [
        ("COL", D("2026-04-09"), 4, 78.0, "high")
    ]
    assert found[0]["surge_ratio"] >= 4 and found[0]["reasons"][0].startswith("Observed 4 case(s)")
    with pytest.raises(ValueError):
        anomaly.detect_anomalies(w.tables(spark), lookback_days=1)


def test_alerts_hotspots_and_dashboard(spark):
    w = base()
    w.report(1, 1, "high", 55, "new").report(2, 1, "medium", 35, "reviewed")
    w.report(3, 2, "critical", 90, "resolved").report(4, 2, "low", 10, "new")
    w.cluster(1, 1, 33.5, 36.2, 1.5, 4, 4).cluster(2, 2, 33.5, 36.2, 0.8, 1, 1)
    t = w.tables(spark)
    assert [r["id"] for r in filters.active_alerts(t).collect()] == [1, 2]
    assert filters.active_alerts(t, disease=2).count() == 0
    assert filters.active_alerts(t, min_risk=40, limit=1).count() == 1
    assert filters.active_hotspots(t).count() == 1
    assert filters.active_hotspots(t, min_case_count=5).count() == 0
    row = counts.dashboard_summary(t).first()
    assert [row[f"{k}_count"] for k in ("active_alert", "critical_alert", "high_alert", "medium_alert", "new_alert", "reviewed_alert", "active_hotspot", "active_case")] == [2, 0, 1, 1, 1, 1, 1, 3]
    assert (row["top_alert_id"], row["top_hotspot_id"]) == (1, 1)
    assert rows(counts.alerts_by_disease(t), "disease_code", "alert_count", "max_risk_score") == [("MEA", 2, 55.0)]


def test_alert_of_cured_trigger_is_not_active(spark):
    w = World()
    w.visit(1, 1, 1, "2026-04-01").visit(2, 1, 1, "2026-04-05", "cured")
    w.report(1, 1, "high", 55, "new", trigger=1)
    assert filters.active_alerts(w.tables(spark)).count() == 0


def test_scopes(spark):
    w = base()
    w.patients[9] = ("female", D("2000-01-01"))
    t = w.tables(spark)
    assert filters.patients_in_hospital(t, 1).count() == 3
    assert rows(filters.patients_in_hospital(t, 5), "id") == [(9,)]
    assert filters.patients_in_hospital(t, None).count() == 0
    assert filters.by_visit_in_hospital(t.geodata, t, 1).count() == 3
    assert filters.visits_in_hospital(t, 7).count() == 0
    history = filters.patient_history(t, patient_id=1).collect()
    assert [r["id"] for r in history] == [3, 1] and history[0]["hospital_name"] == "Central Hospital"


def test_generated_report(spark):
    t = base().tables(spark)
    row = reports.generate_reports(t, disease_id=1).first()
    assert (row["current_case_count"], row["risk_score"], row["alert_level"]) == (2, 45.0, "high")
    assert row["reasons"][1] == "Current period captured 2 case(s)."
    assert reports.generate_reports(t, disease_id=4).count() == 0
    assert datetime.combine(row["analysis_period_start"], datetime.min.time()) == datetime(2026, 4, 1)
