"""CSV imports: cleaning, quarantine, key repair, upsert and derived rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epiwake.functions.clinical import blank_to_null, clean_text, valid_coordinates
from epiwake.operators.policy import REFERENCE_SOURCE, classify_diseases
from epiwake.session import cut_lineage
from epiwake.tables import Tables

# The header every disease file must have.
DISEASE_HEADER = [
    "id", "disease_code", "name", "type", "transmission_vector", "symptoms", "risk_level",
    "infection_score",
]
GROUPS = ("hospitals", "users", "doctors", "patients", "visits")


class ImportFailed(ValueError):
    """The input as a whole was refused."""


@dataclass(frozen=True)
class Loaded:
    """Accepted rows, and refused rows with their reason; both with their file position."""

    good: DataFrame
    bad: DataFrame


def read_csv(spark: SparkSession, path: str, header: list[str], sep: str = ",") -> DataFrame:
    """All columns as text, plus ``row_number`` in order of file path and line, starting at 1.

    Fields may be quoted and then hold separators, doubled quotes and line breaks. A file is still read by
    many tasks: whether a line begins inside a quoted field follows from the number of quotes before it,
    which is the sum of the earlier blocks' counts and of the lines before it in its own block. Each file
    has its header; empty lines do not count. A quote within an unquoted field must be doubled and quoted.
    """
    columns = spark.read.csv(path, header=True, sep=sep, quote='"', escape='"', multiLine=True, encoding="UTF-8").columns
    names = [c.lstrip("\ufeff").strip() for c in columns]
    missing = sorted(set(header) - set(names))
    if missing:
        raise ImportFailed("missing columns: " + ", ".join(missing))
    options = {"sep": sep, "quote": '"', "escape": '"'}
    fields = F.from_csv("record", ",".join(f"c{k} string" for k in range(len(names))), options)
    records = csv_records(spark, path).withColumn("fields", fields)
    return records.select(*[F.col(f"fields.c{k}").alias(name) for k, name in enumerate(names)], "row_number")


LINES = "value string, _file string, _block long, _at long, _quotes long, _odd long, _seen array<long>"


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with their place in the block, whether the quotes before them in it are odd, and the records
    begun in it up to them, if the block begins outside and if it begins inside a quoted field.

    A task reads the lines of a block one after the other.
    """
    block, at, odd, seen = None, 0, 0, [0, 0]
    for batch in batches:
        n, value, file, start = batch.num_rows, batch.column(0), batch.column(1), batch.column(2)
        if not n:
            continue
        quotes = pc.count_substring(value, '"').to_numpy(zero_copy_only=False).astype(np.int64)
        blank = pc.is_in(value, pa.array(["", "\r"], value.type)).to_numpy(zero_copy_only=False)
        fresh = np.ones(n, bool)
        fresh[1:] = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(start[1:], start[:-1])).to_numpy(zero_copy_only=False)
        firsts = np.flatnonzero(fresh)
        place, before, records = np.empty(n, np.int64), np.empty(n, np.int64), np.empty((n, 2), np.int64)
        for a, b in zip(firsts, [*firsts[1:], n]):
            if (file[a], start[a]) != block:
                block, at, odd, seen = (file[a], start[a]), 0, 0, [0, 0]
            total = odd + np.cumsum(quotes[a:b])
            before[a:b] = (total - quotes[a:b]) % 2
            place[a:b] = np.arange(at, at + b - a)
            for inside in (0, 1):
                records[a:b, inside] = seen[inside] + np.cumsum((before[a:b] == inside) & ~blank[a:b])
                seen[inside] = int(records[b - 1, inside])
            at, odd = at + int(b - a), int(total[-1]) % 2
        pairs = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * n + 1, 2, dtype=np.int32)), pa.array(records.ravel()))
        yield pa.RecordBatch.from_arrays([value, file, start, pa.array(place), pa.array(quotes), pa.array(before), pairs], ["value", "_file", "_block", "_at", "_quotes", "_odd", "_seen"])


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(record, row_number): the text of each record but the files' headers."""
    block = ["_file", "_block"]
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    lines = cut_lineage(lines.mapInArrow(_in_blocks, LINES))
    # A row per block and file: whether it begins inside a field, records before it, headers up to its file.
    totals = lines.groupBy(*block).agg(F.sum("_quotes").alias("_quotes"), F.max("_seen").alias("_seen"))
    earlier_blocks = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.pmod(F.coalesce(F.sum("_quotes").over(earlier_blocks), F.lit(0)), F.lit(2)).cast("int")
    sizes = totals.withColumn("_carried", carried).withColumn("_n", F.get("_seen", F.col("_carried")))
    earlier = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut_lineage(sizes.select(*block, "_carried", "_n", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")))
    files = sizes.groupBy("_file").agg(F.min("_start").alias("_first"), F.sum("_n").alias("_n")).select(
        "_file", "_first", F.sum((F.col("_n") > 0).cast("long")).over(Window.orderBy("_file")).alias("_headers"))
    # A row per block of a file is small whatever the input, so the lines stay where they are.
    lines = lines.join(F.broadcast(sizes.drop("_n").join(files, "_file")), block)
    # A line begins a record unless it begins inside a quoted field.
    inside = F.col("_odd") != F.col("_carried")
    begins = ~inside & ~F.col("value").isin("", "\r")
    number = F.col("_start") + F.get("_seen", F.col("_carried"))
    lines = lines.filter((inside | begins) & (number > F.col("_first") + 1)).withColumn("row_number", number - F.col("_headers"))
    whole = begins & (F.pmod("_quotes", F.lit(2)) == 0)
    # Only records over several lines have to be gathered.
    parts = lines.filter(~whole).groupBy("row_number").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_block", "_at", "value"))), lambda x: x.value), "\n").alias("value"))
    records = lines.filter(whole).select("row_number", "value").unionByName(parts)
    return records.select(F.regexp_replace("value", "\r$", "").alias("record"), "row_number")


def with_row_number(df: DataFrame, name: str = "row_number") -> DataFrame:
    marked = df.withColumn("_key", F.monotonically_increasing_id())
    # The key holds the partition in the high bits and the offset in the low 33.
    part, offset = F.shiftright("_key", 33), F.col("_key").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = marked.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (
        marked.withColumns({"_part": part, "_offset": offset})
        .join(starts, "_part")
        .withColumn(name, F.col("_start") + F.col("_offset") + 1)
        .drop("_key", "_part", "_offset", "_start")
    )


def stop_after(df: DataFrame, rows: int | None) -> DataFrame:
    return df if rows is None else df.filter(F.col("row_number") <= rows)


def _split(df: DataFrame, rules: dict[str, Column], keep: list[str]) -> Loaded:
    reasons = F.array_compact(F.array(*[F.when(test, F.lit(text)) for text, test in rules.items()]))
    kept = [k if isinstance(k, Column) else F.col(k) for k in keep]
    # Stored, because a filter on the reasons would be pushed down to the lines, with the parsing of the record
    # once for each time that a rule names one of its fields.
    judged = cut_lineage(df.select(F.struct(*kept).alias("kept"), "row_number", reasons.alias("reasons")))
    good = judged.filter(F.size("reasons") == 0).select("kept.*", "row_number")
    bad = judged.filter(F.size("reasons") > 0).select(
        "row_number", F.array_join("reasons", "; ").alias("reason")
    )
    return Loaded(good, bad)


def _number(name: str, dtype: str = "double") -> Column:
    return blank_to_null(F.col(name)).try_cast(dtype)


def _not_a_number(name: str, dtype: str = "double", required: bool = False) -> Column:
    text = blank_to_null(F.col(name))
    wrong = text.isNotNull() & text.try_cast(dtype).isNull()
    return (wrong | text.isNull()) if required else wrong


def load_diseases(
    spark: SparkSession, path: str, source_name: str = REFERENCE_SOURCE
) -> DataFrame:
    """Classified reference diseases; any bad row refuses the whole file."""
    if not path.lower().rstrip("/").endswith(".csv"):
        raise ImportFailed("the path does not name a .csv file")
    return clean_diseases(read_csv(spark, path, DISEASE_HEADER, sep=";"), source_name)


def clean_diseases(raw: DataFrame, source_name: str = REFERENCE_SOURCE) -> DataFrame:
    # Data rows start on line 2 of the file.
    line = F.col("row_number") + 1
    number_columns = {"risk_level": "int", "infection_score": "double", "id": "long"}
    no_key = (clean_text(F.col("disease_code")) == "") | (clean_text(F.col("name")) == "")
    bad_number = F.lit(False)
    for name, dtype in number_columns.items():
        bad_number = bad_number | _not_a_number(name, dtype)
    problem = F.when(no_key, "disease_code and name are required").when(bad_number, "a number is invalid")
    first = (
        raw.select(line.alias("line"), problem.alias("problem"))
        .filter("problem is not null")
        .agg(F.min(F.struct("line", "problem")).alias("first"))
        .first()["first"]
    )
    if first is not None:
        raise ImportFailed(f"row {first['line']}: {first['problem']}")
    cleaned = raw.select(
        "row_number",
        F.upper(clean_text(F.col("disease_code"))).alias("disease_code"),
        *[clean_text(F.col(c)).alias(c) for c in ("name", "type", "transmission_vector", "symptoms")],
        F.coalesce(_number("risk_level", "int"), F.lit(0)).alias("risk_level"),
        F.coalesce(_number("infection_score"), F.lit(0.0)).alias("infection_score"),
        F.coalesce(_number("id", "int"), F.lit(0)).alias("source_record_id"),
    )
    return classify_diseases(cleaned, source_name.strip() or REFERENCE_SOURCE)


def clean_hospitals(raw: DataFrame) -> Loaded:
    n = F.col("row_number")
    name = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.concat(F.lit("Hospital "), n.cast("string")))
    rows = raw.withColumns(
        {
            "id": n, "clean_name": clean_text(name, 255), "location": clean_text(F.col("location"), 100),
            "city": clean_text(F.col("city"), 100),
            "hospital_lat": _number("latitude"), "hospital_long": _number("longitude"),
        }
    ).drop("name").withColumnRenamed("clean_name", "name")
    rules = {
        "latitude is not a number": _not_a_number("latitude", required=True),
        "longitude is not a number": _not_a_number("longitude", required=True),
        "coordinates are out of range": ~valid_coordinates(F.col("hospital_lat"), F.col("hospital_long")),
    }
    return _split(rows, rules, ["id", "name", "hospital_lat", "hospital_long", "location", "city"])


def clean_users(raw: DataFrame) -> Loaded:
    limits = {
        "username": 150, "email": 254, "first_name": 150, "last_name": 150, "real_name": 255,
        "phon_number": 20,
    }
    role = F.coalesce(F.nullif(F.col("role"), F.lit("")), F.lit("doctor"))
    yes = F.lit(True)
    rows = raw.drop("password").withColumns(
        {
            "user_id": _number("id", "long"), "role": clean_text(role, 20),
            **{c: clean_text(F.col(c), size) for c, size in limits.items()},
            "is_active": yes, "email_verified": yes, "admin_approved": yes,
        }
    )
    rules = {
        "id is not a number": _not_a_number("id", "long", required=True),
        "role is not in the domain": ~F.col("role").isin("admin", "doctor"),
    }
    good = [F.col("user_id").alias("id"), *limits, "role", "is_active", "email_verified", "admin_approved"]
    return _split(rows, rules, good)


def clean_doctors(raw: DataFrame, hospitals: DataFrame, low: int = 1, high: int = 65) -> Loaded:
    """Doctors; an unknown hospital is replaced by one from the id range, else by any."""
    ids = ("id", "user_id", "hospital_id")
    rules = {f"{c} is not a number": _not_a_number(c, "long", required=True) for c in ids}
    rows = raw.withColumns(
        {f"{c}_": _number(c, "long") for c in ids} | {"specialization": clean_text(F.col("specialization"), 255)}
    )
    keep = [F.col(f"{c}_").alias(c) for c in ids] + ["specialization"]
    split = _split(rows, rules, keep)
    return Loaded(repair_hospitals(split.good, hospitals, low, high), split.bad)


def repair_hospitals(doctors: DataFrame, hospitals: DataFrame, low: int, high: int) -> DataFrame:
    preferred = F.col("id").between(low, high)
    pools = hospitals.select("id", preferred.alias("preferred"))
    found = pools.agg(F.count(F.lit(1)).alias("n"), F.count_if("preferred").alias("p")).first()
    if found["n"] == 0:
        raise ImportFailed("there are no hospitals; load them before the doctors")
    pool = pools.filter("preferred") if found["p"] else pools
    numbered = with_row_number(pool.select(F.col("id").alias("substitute")), "slot")
    size = found["p"] or found["n"]
    known = hospitals.select(F.col("id").alias("hospital_id"), F.lit(True).alias("known"))
    slot = F.pmod(F.xxhash64("id"), F.lit(size)) + 1
    # Only the unknown ones take the detour through the numbered pool.
    marked = doctors.join(known, "hospital_id", "left").withColumn("slot", F.when(F.col("known").isNull(), slot))
    rest = [c for c in doctors.columns if c == "row_number"]
    return marked.join(numbered, "slot", "left").select(
        "id", "user_id", "specialization", F.coalesce("substitute", "hospital_id").alias("hospital_id"), *rest
    )


def clean_patients(raw: DataFrame) -> Loaded:
    coordinates = ("residence_lat", "residence_long", "work_lat", "work_long")
    birth = F.try_to_date(F.trim("birth_date"), "yyyy-MM-dd")
    rows = raw.withColumns(
        {
            "patient_id": _number("id", "long"),
            "national_number": clean_text(F.col("national_number"), 20),
            "name": clean_text(F.col("name"), 255),
            "born": birth,
            "gender": F.lower(clean_text(F.col("gender"))),
            **{f"{c}_": _number(c) for c in coordinates},
        }
    )
    rules = {
        "id is not a number": _not_a_number("id", "long", required=True),
        "birth_date is not a date": F.col("born").isNull(),
        **{f"{c} is not a number": _not_a_number(c) for c in coordinates},
        "gender is not in the domain": ~F.col("gender").isin("male", "female"),
        **{f"{c} is out of range": F.abs(F.col(f"{c}_")) > (90 if c.endswith("lat") else 180) for c in coordinates},
    }
    keep = [
        F.col("patient_id").alias("id"), "national_number", "name", F.col("born").alias("birth_date"),
        "gender", *[F.col(f"{c}_").alias(c) for c in coordinates],
    ]
    return _split(rows, rules, keep)


def import_marital(col: Column) -> Column:
    text = F.lower(clean_text(col))
    return F.when(text == "divorce", "divorced").when(text == "widow(er)", "widow").otherwise(text)


def clean_visits(raw: DataFrame) -> Loaded:
    ids = ("id", "patient_id", "doctor_id", "disease_id")
    text = F.trim("diagnosis_date")
    day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
    rows = raw.withColumns(
        {
            **{f"{c}_": _number(c, "long") for c in ids},
            "day": day, "status": F.lower(clean_text(F.col("status"))),
            "weight_": _number("weight"), "height_": _number("height"),
            "marital_status": import_marital(F.col("marital_status")),
        }
    )
    rules = {
        **{f"{c} is not a number": _not_a_number(c, "long", required=True) for c in ids},
        "diagnosis_date is not an ISO date": F.col("day").isNull(),
        "weight is missing or not a number": _not_a_number("weight", required=True),
        "height is missing or not a number": _not_a_number("height", required=True),
        "weight is out of range": (F.col("weight_") <= 0) | (F.col("weight_") > 500),
        "height is out of range": ~F.col("height_").between(30, 250),
        "status is not in the domain": ~F.col("status").isin("infected", "cured"),
        "marital_status is not in the domain": ~F.col("marital_status").isin("divorced", "single", "married", "widow"),
    }
    keep = [
        *[F.col(f"{c}_").alias(c) for c in ids], F.lit("").alias("diagnose"),
        F.col("day").alias("diagnosis_date"), "status", F.col("weight_").alias("weight"),
        F.col("height_").alias("height"), "marital_status",
    ]
    return _split(rows, rules, keep)


def missing_references(visits: DataFrame, t: Tables) -> DataFrame:
    """(reference, missing id) for visits that name an unknown patient, doctor or disease."""
    parts = []
    for column, table in (("patient_id", t.patient), ("doctor_id", t.doctor), ("disease_id", t.disease)):
        known = table.select(F.col("id").alias(column))
        absent = visits.select(column).distinct().join(known, column, "left_anti")
        parts.append(absent.select(F.lit(column).alias("reference"), F.col(column).alias("missing_id")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def require_references(visits: DataFrame, t: Tables, shown: int = 20) -> None:
    """Refuse the file when a reference is missing, naming the lowest ids of each kind."""
    missing = missing_references(visits, t)
    messages = []
    for column in ("patient_id", "doctor_id", "disease_id"):
        rows = missing.filter(F.col("reference") == column).orderBy("missing_id").limit(shown).collect()
        if rows:
            messages.append(f"missing {column}: {[r['missing_id'] for r in rows]}")
    if messages:
        raise ImportFailed("visits refer to unknown rows; " + "; ".join(messages))


def last_row_wins(incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    newest = Window.partitionBy(*keys).orderBy(F.desc(order))
    return (
        incoming.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank", order)
    )


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """New version of a table: incoming columns win, other columns and rows are kept.

    ``change`` tells created, updated and kept rows apart.
    """
    left, right = existing.withColumn("_old", F.lit(True)), incoming.withColumn("_new", F.lit(True))
    names = list(dict.fromkeys([*existing.columns, *incoming.columns]))
    fields = []
    for name in names:
        if name in keys:
            fields.append(F.col(name))
        elif name in incoming.columns and name in existing.columns:
            fields.append(F.when(F.col("n._new"), F.col(f"n.{name}")).otherwise(F.col(f"o.{name}")).alias(name))
        else:
            fields.append(F.col(f"{'n' if name in incoming.columns else 'o'}.{name}").alias(name))
    change = F.when(F.col("n._new").isNull(), "kept").when(F.col("o._old").isNull(), "created").otherwise("updated")
    return left.alias("o").join(right.alias("n"), keys, "full_outer").select(*fields, change.alias("change"))


def assign_ids(df: DataFrame, table: DataFrame) -> DataFrame:
    """Give rows without an id the next free ones."""
    highest = table.agg(F.coalesce(F.max("id"), F.lit(0).cast("long"))).scalar()
    fresh = with_row_number(df.filter("id is null").drop("id"), "_seq")
    named = fresh.withColumn("id", highest + F.col("_seq")).drop("_seq")
    return df.filter("id is not null").unionByName(named.select(*df.columns))


@dataclass(frozen=True)
class VisitPlan:
    """What an import does with visits: rows to insert and known rows to replay or skip."""

    insert: DataFrame
    replay: DataFrame
    skip: DataFrame


def plan_visits(incoming: DataFrame, visits: DataFrame, replay_existing: bool = False) -> VisitPlan:
    known = visits.select("id")
    present = incoming.join(known, "id", "left_semi")
    none = present.filter(F.lit(False))
    return VisitPlan(
        incoming.join(known, "id", "left_anti"),
        present if replay_existing else none,
        none if replay_existing else present,
    )


def derive_points(visits: DataFrame, patients: DataFrame, points: DataFrame) -> DataFrame:
    """Home and work points of visits from the patients' addresses, where not yet present."""
    def place(region: str, lat: str, lon: str) -> Column:
        return F.struct(F.lit(region).alias("region"), F.col(lat).alias("lat"), F.col(lon).alias("lon"))

    address = patients.select(
        F.col("id").alias("patient_id"),
        F.array(
            place("home", "residence_lat", "residence_long"), place("work", "work_lat", "work_long")
        ).alias("places"),
    )
    wanted = (
        visits.select(F.col("id").alias("visit_id"), "patient_id")
        .join(address, "patient_id")
        .select("visit_id", "patient_id", F.explode("places").alias("p"))
        .filter(valid_coordinates(F.col("p.lat"), F.col("p.lon")))
        .select(
            "patient_id", "visit_id", F.col("p.lat").alias("latitude"),
            F.col("p.lon").alias("longitude"), F.col("p.region").alias("region_type"),
        )
    )
    return wanted.join(points.select("visit_id", "region_type"), ["visit_id", "region_type"], "left_anti")


def missing_histories(patients: DataFrame, histories: DataFrame) -> DataFrame:
    absent = patients.select(F.col("id").alias("patient_id")).join(
        histories.select("patient_id"), "patient_id", "left_anti"
    )
    return absent.withColumn("has_surgical_metal_plates", F.lit(False))


def dry_run(plan: VisitPlan) -> DataFrame:
    """Counts of what the import would do; nothing is written."""
    parts = {"insert": plan.insert, "replay": plan.replay, "skip": plan.skip}
    out = None
    for name, df in parts.items():
        row = df.agg(F.count(F.lit(1)).alias("visits")).select(F.lit(name).alias("action"), "visits")
        out = row if out is None else out.unionByName(row)
    return out
