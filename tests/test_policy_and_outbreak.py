"""Classification, policies, nearby search and outbreak scoring."""

import random

import pytest
from pyspark.sql import functions as F

from epiwake.operators import hotspots, outbreak, policy, spatial
from world import D, World, base, rows

POLICY_IN = "id long, disease_code string, risk_level int, infection_score double, high_priority boolean, rare_disease boolean, policy_profile string"


def one_policy(spark, *values):
    return policy.alert_policies(spark.createDataFrame([(1, *values)], POLICY_IN)).first().asDict()


@pytest.mark.parametrize(
    "values, expected",
    [
        ((" flu ", 2, 1.5, False, False, None), dict(disease_code="FLU", high_priority=False, rare_disease=False, lookback_days=7, cluster_case_threshold=3, critical_case_threshold=6)),
        (("mea", 5, 4.5, False, False, None), dict(high_priority=True, rare_disease=False, lookback_days=14, baseline_window_days=21, cluster_case_threshold=1, critical_case_threshold=2, severity_weight=2.2)),
        (("pol", 5, 4.0, False, False, None), dict(high_priority=True, rare_disease=True, lookback_days=30, radius_km=10.0, cluster_case_threshold=1, critical_case_threshold=1, rarity_weight=3.0)),
        (("col", 4, 3.0, False, False, None), dict(high_priority=False, rare_disease=False, baseline_window_days=14, cluster_case_threshold=2, critical_case_threshold=4, density_weight=1.8, trend_weight=1.8)),
        (("1A00", 4, 0.82, False, False, "cluster_sensitive"), dict(disease_code="1A00", baseline_window_days=14, cluster_case_threshold=2, critical_case_threshold=4, rare_disease=False)),
        (("1C81", 5, 0.2, True, True, "rare"), dict(cluster_case_threshold=1, critical_case_threshold=1, rarity_weight=3.0)),
        (("1E32", 4, 0.67, False, False, "surge_sensitive"), dict(lookback_days=7, baseline_window_days=21, cluster_case_threshold=4, critical_case_threshold=7)),
        (("1B1Z", 4, 0.79, True, False, "surge_sensitive"), dict(high_priority=True, lookback_days=30, baseline_window_days=60, cluster_case_threshold=2)),
        (("zzz", 1, 0.1, False, True, "general"), dict(high_priority=False, rare_disease=True, cluster_case_threshold=1, critical_case_threshold=1)),
        (("col", 1, 0.1, False, True, "rare"), dict(high_priority=True, rare_disease=True, cluster_case_threshold=2, critical_case_threshold=4)),
    ],
)
def test_policy(spark, values, expected):
    got = one_policy(spark, *values)
    assert {k: got[k] for k in expected} == expected


def test_blank_code_is_refused(spark):
    with pytest.raises(Exception):
        one_policy(spark, "   ", 1, 1.0, False, False, None)


def test_classification(spark):
    data = [
        ("1F03", "Measles", "epidemic_infectious", "airborne_droplet", 4, 0.92),
        ("1E70", "Smallpox", "high_alert_notifiable", "", 5, 0.9),
        ("1A09.0", "Salmonella enteritis", "gastrointestinal", "foodborne", 3, 0.6),
        ("DA22.Z", "Reflux", "gastrointestinal", "none", 1, 0.05),
        ("CA23", "Asthma", "respiratory", "none", 2, 0.1),
    ]
    df = spark.createDataFrame(data, "disease_code string, name string, type string, transmission_vector string, risk_level int, infection_score double")
    got = {r["disease_code"]: (r["policy_profile"], r["high_priority"], r["rare_disease"]) for r in policy.classify_diseases(df).collect()}
    assert got == {
        "1F03": ("high_priority", True, False), "1E70": ("rare", True, True), "1A09.0": ("cluster_sensitive", False, False),
        "DA22.Z": ("general", False, False), "CA23": ("environmental_signal", False, False),
    }


def nearby_world():
    w = World()
    w.visit(1, 1, 1, "2026-04-10", points=[(33.5000, 36.2500, "home")])
    w.visit(2, 2, 1, "2026-04-08", points=[(33.5040, 36.2520, "home")])
    w.visit(3, 3, 1, "2026-04-09", points=[(33.5060, 36.2510, "work")])
    w.visit(4, 4, 1, "2026-04-09", points=[(33.6200, 36.4000, "home")])
    w.visit(5, 5, 1, "2026-03-28", points=[(33.5005, 36.2505, "home")])
    w.visit(6, 6, 2, "2026-04-09", points=[(33.5008, 36.2508, "home")])
    return w


def spans(spark, radius=1.0, back=7):
    return spark.createDataFrame([(1, back, radius), (2, back, radius)], "disease_id long, lookback_days int, radius_km double")


def test_nearby_cases(spark):
    t = nearby_world().tables(spark)
    contexts = outbreak.contexts_of(t).filter("visit_id = 1")
    listed = spatial.nearby_list(spatial.nearby_cases(t, contexts, spans(spark))).first()["cases"]
    assert [c["case_visit_id"] for c in listed] == [2, 3]
    home = outbreak.contexts_of(t, own_region=True).filter("visit_id = 1")
    assert rows(spatial.nearby_cases(t, home, spans(spark)), "case_visit_id") == [(2,)]
    assert rows(spatial.nearby_counts(t, contexts, spans(spark)), "nearby_case_count") == [(2,)]


@pytest.mark.parametrize("leaf", [spatial.LEAF_PLACES, 0.05])
@pytest.mark.parametrize("own_region", [False, True])
def test_nearby_counts_equal_brute_force(spark, own_region, leaf):
    from test_clustering import km

    rng = random.Random(11)
    w = World()
    spots = [(33.5 + rng.random() / 20, 36.2 + rng.random() / 20) for _ in range(12)]
    for i in range(1, 140):
        home, work = rng.choice(spots), rng.choice(spots)
        points = [(*home, "home")] + ([(*work, "work")] if rng.random() < 0.6 else [])
        points += [(*rng.choice(spots), rng.choice(["home", "work"])) for _ in range(rng.choice([0, 0, 1, 3]))]
        w.visit(i, rng.randint(1, 40), rng.randint(1, 2), f"2026-04-{rng.randint(1, 25):02d}", rng.choice(["infected", "infected", "cured"]), points)
    t = w.tables(spark)
    policies = spark.createDataFrame([(1, 7, 2.0), (2, 12, 0.8)], "disease_id long, lookback_days int, radius_km double")
    settings = {1: (7, 2.0), 2: (12, 0.8)}
    visits = {v[0]: v for v in w.visits}

    def in_force(disease, end, back):
        latest = {}
        for v in sorted(w.visits, key=lambda v: (v[5], v[0])):
            if v[3] == disease and end - back <= v[5].toordinal() <= end:
                latest[v[1]] = v
        return {v[0] for v in latest.values() if v[6] == "infected"}

    expected = {}
    for gid, _, vid, lat, lon, region in w.points:
        v = visits[vid]
        back, radius = settings[v[3]]
        live = in_force(v[3], v[5].toordinal(), back)
        if vid in live:
            expected[gid] = len({p[2] for p in w.points if p[2] in live and p[2] != vid and (not own_region or p[5] == region)
                                 and km(lat, lon, p[3], p[4]) <= radius})
    contexts = outbreak.contexts_of(t, own_region=own_region).filter(F.col("geodata_id").isin(list(expected)))
    got = {r["geodata_id"]: r["nearby_case_count"] for r in spatial.nearby_counts(t, contexts, policies, leaf).collect()}
    assert got == expected


@pytest.mark.parametrize("own_region", [False, True])
def test_listed_cases_equal_brute_force(spark, own_region):
    from test_clustering import km

    rng = random.Random(12)
    w = World()
    spots = [(33.5 + rng.random() / 25, 36.2 + rng.random() / 25) for _ in range(12)]
    for i in range(1, 110):
        # Some visits have points at one place, or of an unknown region, so that distances are equal.
        points = [(*rng.choice(spots), rng.choice(["home", "work", "work", None])) for _ in range(rng.choice([1, 1, 2, 2, 3, 5]))]
        w.visit(i, i, rng.randint(1, 2), f"2026-04-{rng.randint(1, 25):02d}", "infected", points)
    t = w.tables(spark)
    policies = spark.createDataFrame([(1, 7, 2.0), (2, 12, 0.8)], "disease_id long, lookback_days int, radius_km double")
    settings, visits = {1: (7, 2.0), 2: (12, 0.8)}, {v[0]: v for v in w.visits}
    expected = []
    for gid, _, vid, lat, lon, region in w.points:
        wanted = region if own_region else None
        back, radius = settings[visits[vid][3]]
        for other, v in visits.items():
            near = [(round(km(lat, lon, p[3], p[4]), 4), p[0], p[5], km(lat, lon, p[3], p[4])) for p in w.points if p[2] == other]
            if other == vid or v[3] != visits[vid][3] or not 0 <= (visits[vid][5] - v[5]).days <= back:
                continue
            # A point of an unknown region is in nobody's reach, but hides those further off.
            rivals = sorted(p for p in near if wanted is None or p[2] in (wanted, None))
            if rivals and rivals[0][3] <= radius and (wanted is None or rivals[0][2] == wanted):
                expected.append((gid, other, rivals[0][0], rivals[0][2] or ""))
    contexts = outbreak.contexts_of(t, own_region=own_region)
    pairs = spatial.nearby_cases(t, contexts, policies)
    got = [(r["geodata_id"], r["case_visit_id"], r["distance_km"], r["case_region"] or "") for r in pairs.collect()]
    assert len(got) > 300 and sorted(got) == sorted(expected)
    few = spatial.nearby_cases(t, contexts, policies, columns=["distance_km", "geodata_id"])
    assert few.columns == ["distance_km", "geodata_id"] and rows(few, "geodata_id", "distance_km") == sorted((g[0], g[2]) for g in expected)
    # Small tables can hold much work, so it is not put into few tasks.
    assert pairs.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_the_spread_of_cases_is_that_of_their_pairs(spark):
    rng = random.Random(13)
    w = World()
    for i in range(1, 90):
        points = [(33.5 + rng.random() / 20, 36.2 + rng.random() / 20, region) for region in ("home", "work")[: rng.randint(1, 2)]]
        w.visit(i, i, 1 + i % 2, f"2026-04-{rng.randint(1, 25):02d}", "infected", points)
    w.points.append((len(w.points) + 1, 1, 1, None, None, "home"))
    t = w.tables(spark)
    policies = spark.createDataFrame([(1, 7, 2.0), (2, 12, 1.5)], "disease_id long, lookback_days int, radius_km double")
    contexts = outbreak.contexts_of(t)
    calling = contexts.withColumns({"should_create_cluster": F.col("geodata_id") % 3 > 0, "local_case_count": F.lit(3).cast("long"), "alert_level": F.lit("high")})
    chosen = calling.filter("should_create_cluster and latitude is not null")
    both = [
        hotspots.clusters_from_analyses(t, chosen, spatial.nearby_cases(t, chosen, policies, **how)) for how in ({}, {"spread": True})
    ]
    pairs, summed = ({r["o3"]: r for r in df.collect()} for df in both)
    assert len(pairs) == chosen.count() and max(r["radius_km"] for r in pairs.values()) > 1
    for key, r in pairs.items():
        assert r.asDict() | {"radius_km": 0} == summed[key].asDict() | {"radius_km": 0}
        assert summed[key]["radius_km"] == pytest.approx(r["radius_km"], abs=1e-9)


def evaluate(spark, w, visit):
    t = w.tables(spark)
    out = outbreak.evaluate_outbreaks(t, outbreak.contexts_of(t), policy.alert_policies(t.disease))
    return out.filter(F.col("visit_id") == visit).first()


def test_single_polio_case_is_critical(spark):
    w = World().visit(1, 1, 3, "2026-04-20", points=[(33.5, 36.25, "home")])
    r = evaluate(spark, w, 1)
    assert (r["alert_level"], r["score"], r["should_create_report"], r["should_create_cluster"], r["nearby_case_count"], r["local_case_count"]) == ("critical", 100.0, True, False, 0, 1)


def test_two_measles_cases(spark):
    # The two measles visits of the base tables are the previous window: trend 2 against 2.
    w = base()
    w.visit(11, 11, 1, "2026-04-18", points=[(33.5000, 36.2500, "home")])
    w.visit(12, 12, 1, "2026-04-20", points=[(33.5005, 36.2505, "home")])
    r = evaluate(spark, w, 12)
    assert (r["current_count"], r["previous_count"]) == (2, 2)
    assert (r["alert_level"], r["nearby_case_count"], r["should_create_report"], r["should_create_cluster"]) == ("critical", 1, True, True)
    assert r["score"] == pytest.approx(53.68, abs=0.011)


def test_lone_mild_case_is_low(spark):
    r = evaluate(spark, World().visit(1, 1, 4, "2026-04-20", points=[(33.5, 36.25, "home")]), 1)
    assert (r["alert_level"], r["should_create_report"], r["should_create_cluster"]) == ("low", False, False)
    assert r["score"] == pytest.approx(17.22, abs=0.011)


def test_cholera_surge_without_neighbours(spark):
    w = World()
    for i, (day, lat) in enumerate([("10", 33.1), ("18", 33.3), ("19", 33.5), ("20", 33.7)], 1):
        w.visit(i, i, 2, f"2026-04-{day}", points=[(lat, 36.25, "home")])
    r = evaluate(spark, w, 4)
    assert (r["alert_level"], r["nearby_case_count"], r["current_count"], r["previous_count"], r["surge_ratio"]) == ("medium", 0, 3, 1, 3.0)
    assert r["score"] == pytest.approx(45.08, abs=0.011)


def test_superseded_and_cured_contexts(spark):
    w = World()
    w.visit(1, 1, 1, "2026-04-18", points=[(33.5, 36.25, "home")])
    w.visit(2, 1, 1, "2026-04-18", "cured", points=[(33.5, 36.25, "home")])
    r = evaluate(spark, w, 1)
    assert (r["alert_level"], r["score"], r["local_case_count"], r["context_active"]) == ("no_alert", 0.0, 0, False)
    assert r["reasons"] == [outbreak.INACTIVE_REASON]


def test_forest_may_only_raise(spark):
    schema = "geodata_id int, context_active boolean, alert_level string, score double, reasons array<string>, ml_alert_level string, ml_confidence double"
    data = [
        (1, True, "low", 10.0, [], "critical", 0.9), (2, True, "low", 10.0, [], "critical", 0.2),
        (3, True, "high", 60.0, [], "medium", 0.9), (4, True, "low", 10.0, [], None, None), (5, False, "no_alert", 0.0, [], None, None),
    ]
    got = outbreak.apply_predictions(spark.createDataFrame(data, schema)).orderBy("geodata_id").collect()
    assert [(r["alert_level"], r["score"], r["decision_source"]) for r in got] == [
        ("critical", 80.0, "random_forest_raise"), ("low", 10.0, "rule_based_ml_low_confidence"),
        ("high", 60.0, "rule_based_ml_not_higher"), ("low", 10.0, "rule_based_ml_unavailable"), ("no_alert", 0.0, "rule_based"),
    ]


def test_distance(spark):
    from epiwake.functions.geo import distance_km

    c = [F.lit(float(x)) for x in (0, 0, 1, 0)]
    row = spark.range(1).select(distance_km(*c).alias("far"), distance_km(c[0], c[1], c[0], c[1]).alias("same")).first()
    assert round(row["far"], 1) == 111.2 and row["same"] == 0.0
    assert D("2026-04-01") == D("2026-04-01")
