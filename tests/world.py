"""Small hand-built tables for operator tests."""

from __future__ import annotations

from datetime import date, datetime

from epiwake.tables import SCHEMAS, Tables

D = date.fromisoformat
DISEASES = {
    1: ("MEA", "Measles", "viral", "airborne", 5, 4.5, "general", False, False),
    2: ("COL", "Cholera", "bacterial", "water", 4, 3.0, "general", False, False),
    3: ("POL", "Polio", "viral", "fecal", 5, 4.0, "general", False, False),
    4: ("FLU", "Flu", "viral", "droplet", 1, 1.0, "general", False, False),
}


def disease_rows():
    return [
        (i, code, name, kind, vector, "", risk, score, None, "", False, profile, hp, rare)
        for i, (code, name, kind, vector, risk, score, profile, hp, rare) in DISEASES.items()
    ]


class World:
    """Collects rows and turns them into a table bundle."""

    def __init__(self):
        self.visits, self.points, self.reports, self.clusters, self.labs = [], [], [], [], []
        self.patients = {}

    def visit(self, vid, patient, disease, day, status="infected", points=(), doctor=1):
        """``points``: (lat, lon, region) triples."""
        self.patients.setdefault(patient, ("male", D("1990-01-01")))
        self.visits.append((vid, patient, doctor, disease, "", D(day), status, 70.0, 175.0, "single"))
        for lat, lon, region in points:
            self.points.append((len(self.points) + 1, patient, vid, float(lat), float(lon), region))
        return self

    def report(self, rid, disease, level, risk, status, start="2026-04-01", end="2026-04-02", trigger=None, at=None):
        stamp = at or datetime(2026, 4, 1, 0, 0, rid % 60)
        self.reports.append((rid, stamp, disease, trigger, D(start), D(end), level, "", float(risk), 0, 0, 0, 0.0, 0.0, [], status))
        return self

    def cluster(self, cid, disease, lat, lon, radius, cases, risk, at=datetime(2026, 4, 1)):
        self.clusters.append((cid, float(lat), float(lon), float(radius), disease, cases, risk, at))
        return self

    def lab(self, lid, visit, result):
        self.labs.append((lid, visit, "c", "n", result, datetime(2026, 4, 1), ""))
        return self

    def tables(self, spark) -> Tables:
        def frame(name, rows):
            return spark.createDataFrame(rows, SCHEMAS[name])

        patients = [(p, str(1000 + p), f"P{p}", born, g, None, None, None, None) for p, (g, born) in self.patients.items()]
        return Tables(
            visit=frame("visit", self.visits), disease=frame("disease", disease_rows()),
            geodata=frame("geodata", self.points), patient=frame("patient", patients),
            doctor=frame("doctor", [(1, 1, "Epidemiology", 1), (2, 2, "Internal Medicine", 1)]),
            hospital=frame("hospital", [(1, "Central Hospital", 33.51, 36.29, "Center", "Damascus")]),
            users=frame("users", [(i, f"doctor{i}", "", "", "", f"Doctor {i}", "", "doctor", True, True, True) for i in (1, 2)]),
            report=frame("report", self.reports), geocluster=frame("geocluster", self.clusters),
            lab_test=frame("lab_test", self.labs),
        )


def base() -> World:
    """Two measles visits and one cholera visit of two patients."""
    w = World()
    w.visit(1, 1, 1, "2026-04-01", points=[(33.5001, 36.2501, "home")], doctor=1)
    w.visit(2, 2, 1, "2026-04-01", points=[(33.5301, 36.2701, "work")], doctor=2)
    w.visit(3, 1, 2, "2026-04-02", points=[(33.5401, 36.2801, "home")], doctor=2)
    return w


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())
