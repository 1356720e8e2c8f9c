"""Density clustering against plain procedural counterparts."""

import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from epiwake.operators import active, dbscan, hdbscan
from epiwake.operators.components import connected_components
from world import World

POINTS = "geodata_id long, visit_id long, patient_id long, disease_id long, diagnosis_date date, latitude double, longitude double, region_type string"


def km(lat1, lon1, lat2, lon2):
    p, q = math.radians(lat1), math.radians(lat2)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))


def cloud(rng, n, diseases=2, blobs=4, spread=0.02, copies=0.2):
    """Random points around a few centres, with some exact copies."""
    centres = [(33 + rng.random() / 3, 36 + rng.random() / 3) for _ in range(blobs)]
    out = []
    for i in range(1, n + 1):
        lat, lon = rng.choice(centres)
        here = (lat + rng.gauss(0, spread), lon + rng.gauss(0, spread))
        if out and rng.random() < copies:
            here = rng.choice(out)[5:7]
        out.append((i, i, i % 17, rng.randint(1, diseases), date(2026, 4, 1) + timedelta(days=rng.randint(0, 9)), *here, rng.choice(["home", "work"])))
    return out


def visit_in_order(points, eps, least):
    """Density clustering as usually told: visit points in order and grow each cluster."""
    points = sorted(points, key=lambda p: (p[4], p[0]))
    near = [[j for j, q in enumerate(points) if km(p[5], p[6], q[5], q[6]) <= eps] for p in points]
    label = {}
    for i in range(len(points)):
        if len(near[i]) < least or i in label:
            continue
        label[i], todo = i, list(near[i])
        while todo:
            j = todo.pop()
            if j not in label:
                label[j] = i
                if len(near[j]) >= least:
                    todo += near[j]
    return {points[i][0]: points[c][0] for i, c in label.items()}


@pytest.mark.parametrize("seed, n, spread, eps, least, copies", [
    (1, 160, 0.02, 1.0, 3, 0.2), (2, 200, 0.004, 1.0, 4, 0.0), (3, 150, 0.05, 3.0, 2, 0.5), (4, 220, 0.003, 0.4, 8, 0.1),
])
def test_dbscan_equals_procedural(spark, seed, n, spread, eps, least, copies):
    points = cloud(random.Random(seed), n, spread=spread, copies=copies)
    got = {r["geodata_id"]: r["cluster_id"] for r in dbscan.dbscan(spark.createDataFrame(points, POINTS), eps, least).collect()}
    expected = {}
    for d in {p[3] for p in points}:
        expected |= visit_in_order([p for p in points if p[3] == d], eps, least)
    assert got == expected and got


def test_full_cells_are_linked_only_when_points_are_near(spark):
    # Two tight groups in neighbouring cells: once just inside the radius, once just outside.
    for gap, clusters in ((0.0080, 1), (0.0095, 2)):
        points = [(i + 1, i, i, 1, date(2026, 4, 1), 33.5 + (i // 10) * gap + (i % 10) * 1e-6, 36.2, "home") for i in range(20)]
        got = dbscan.dbscan(spark.createDataFrame(points, POINTS), 1.0, 3)
        assert got.select("cluster_id").distinct().count() == clusters


def test_dbscan_summary(spark):
    t = World().visit(1, 1, 1, "2026-04-10").tables(spark)
    spots = [(33.5000, 36.2500, "2026-04-10"), (33.5006, 36.2504, "2026-04-11"), (33.5010, 36.2506, "2026-04-12"), (33.62, 36.42, "2026-04-12")]
    points = [(i, i, i, 1, date.fromisoformat(d), lat, lon, "home") for i, (lat, lon, d) in enumerate(spots, 1)]
    rows = dbscan.summarise_clusters(dbscan.dbscan(spark.createDataFrame(points, POINTS), 1.0, 2), t).collect()
    assert [(r["point_count"], r["unique_visit_count"], r["diagnosis_end"].isoformat(), r["region_types"]) for r in rows] == [(3, 3, "2026-04-12", ["home"])]
    assert rows[0]["center_lat"] == pytest.approx(33.500533)
    for bad in ({"eps_km": 0}, {"min_samples": 1}):
        with pytest.raises(ValueError):
            dbscan.dbscan(spark.createDataFrame(points, POINTS), **bad)


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 160)]
    nodes = spark.createDataFrame([(i,) for e in edges for i in e] + [(500,)], "node long").distinct()
    got = connected_components(nodes, spark.createDataFrame(edges, "src long, dst long")).groupBy("root").count().collect()
    assert sorted(r["count"] for r in got) == [1, 60, 60]


def top_down(points, size, samples, method="eom", single=False):
    """Hierarchical density clustering from the full distance matrix, tree cut from the top."""
    n = len(points)
    d = [[km(p[5], p[6], q[5], q[6]) for q in points] for p in points]
    k = max(1, min(n - 1, samples))
    core = [sorted(row)[k] for row in d]
    edges = sorted((max(core[i], core[j], d[i][j]), points[i][0], points[j][0], i, j) for i in range(n) for j in range(i))
    group = {i: (i, [i], None) for i in range(n)}  # tree node: (name, members, (weight, left, right))
    of = list(range(n))
    for w, _, _, i, j in edges:
        a, b = of[i], of[j]
        if a != b:
            group[("m", a, b)] = node = (None, group[a][1] + group[b][1], (w, group[a], group[b]))
            for m in node[1]:
                of[m] = ("m", a, b)
    root = group[of[0]]
    clusters, exits = [], {}

    def descend(node, cluster):
        while node[2] is not None:
            w, left, right = node[2]
            lam = 1 / max(w, 1e-12)
            big = [s for s in (left, right) if len(s[1]) >= size]
            for s in (left, right):
                if s not in big:
                    for m in s[1]:
                        exits[m] = (cluster["id"], lam)
                    cluster["rows"].append((lam, len(s[1])))
            if len(big) == 2:
                for s in big:
                    cluster["rows"].append((lam, len(s[1])))
                    child = {"id": len(clusters), "parent": cluster["id"], "birth": lam, "rows": []}
                    clusters.append(child)
                    descend(s, child)
                return
            if not big:
                return
            node = big[0]
        exits[node[1][0]] = (cluster["id"], cluster["rows"][-1][0] if cluster["rows"] else 1e12)

    clusters.append({"id": 0, "parent": None, "birth": 0.0, "rows": []})
    descend(root, clusters[0])
    kids = {c["id"]: [x["id"] for x in clusters if x["parent"] == c["id"]] for c in clusters}
    chosen, best = set(), {}
    for c in reversed(clusters):
        own = sum((lam - c["birth"]) * m for lam, m in c["rows"])
        below = sum(best[x] for x in kids[c["id"]])
        allowed = c["parent"] is not None or single
        if method == "leaf":
            if not kids[c["id"]] and allowed:
                chosen.add(c["id"])
            best[c["id"]] = own
        elif kids[c["id"]] and below > own:
            best[c["id"]] = below
        else:
            best[c["id"]] = own
            if allowed:
                todo = list(kids[c["id"]])
                while todo:
                    x = todo.pop()
                    chosen.discard(x)
                    todo += kids[x]
                chosen.add(c["id"])
    out = {}
    for m, (c, lam) in exits.items():
        at = c
        while at is not None and at not in chosen:
            at = clusters[at]["parent"]
        if at is not None:
            death = max(x for x, _ in clusters[at]["rows"])
            if clusters[at]["parent"] is not None or lam >= death:
                out[points[m][0]] = (at, min(lam / death, 1.0))
    return out


def partition(labels):
    groups = {}
    for point, cluster in labels.items():
        groups.setdefault(cluster, set()).add(point)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("seed, size, samples, method, single, local_rows", [
    (1, 3, None, "eom", False, 10**6), (1, 3, None, "eom", False, 6), (2, 5, 2, "eom", False, 10**6),
    (3, 4, None, "leaf", False, 9), (4, 6, 3, "eom", True, 10**6),
])
def test_hdbscan_equals_top_down(spark, seed, size, samples, method, single, local_rows):
    points = cloud(random.Random(seed), 90, diseases=1, copies=0.0, spread=0.02)
    df = spark.createDataFrame(points, POINTS)
    got = hdbscan.hdbscan(df, size, samples, method, single, local_rows=local_rows).filter("cluster_id is not null").collect()
    expected = top_down(points, size, samples or size, method, single)
    assert partition({r["geodata_id"]: r["cluster_id"] for r in got}) == partition({p: c for p, (c, _) in expected.items()})
    assert {r["geodata_id"]: round(r["probability"], 6) for r in got} == {p: round(x, 6) for p, (_, x) in expected.items()}
    assert got


def test_hdbscan_with_coincident_points(spark):
    spots = [(33.5, 36.2)] * 5 + [(33.5 + i * 1e-4, 36.3) for i in range(5)] + [(34.5, 37.5)]
    points = [(i, i, i, 1, date(2026, 4, 1), *s, "home") for i, s in enumerate(spots, 1)]
    got = hdbscan.hdbscan(spark.createDataFrame(points, POINTS), 4).filter("cluster_id is not null")
    assert sorted(r["count"] for r in got.groupBy("cluster_id").count().collect()) == [5, 5]
    with pytest.raises(ValueError):
        hdbscan.hdbscan(spark.createDataFrame(points, POINTS), 1)


def test_too_few_points_are_noise(spark):
    points = [(i, i, i, 1, date(2026, 4, 1), 33.5, 36.2 + i / 100, "home") for i in (1, 2)]
    got = hdbscan.hdbscan(spark.createDataFrame(points, POINTS), 3)
    assert got.filter(F.col("cluster_id").isNull()).count() == 2


def test_rows_multiplied_by_cells_are_not_broadcast(spark, monkeypatch):
    from epiwake.operators import hdbscan as module

    plans, store = [], module.cut_lineage

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df)

    monkeypatch.setattr(module, "cut_lineage", noted)
    places = module._places(spark.createDataFrame(cloud(random.Random(3), 40), POINTS), 2)
    module.spanning_tree(places, module.core_distances(places)).count()
    lines = [line for plan in plans for line in plan.split("\n") if "cell" in line]
    assert any("SortMergeJoin" in line for line in lines)
    assert not any("BroadcastHashJoin" in line for line in lines)


def test_summary_reads_labels_once(spark):
    w = World()
    for k in range(4):
        w.visit(k + 1, k + 1, 1, "2026-04-01", points=[(33.5, 36.25, "home")])
    t = w.tables(spark)
    points = active.collect_points(t).filter("region_type <> 'nowhere'")
    plan = dbscan.summarise_clusters(points.withColumn("cluster_id", F.lit(1)), t)._jdf.queryExecution().executedPlan().toString()
    assert "nowhere" not in plan
