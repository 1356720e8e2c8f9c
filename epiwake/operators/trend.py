"""Active-case counts inside date windows, for many windows at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epiwake.functions.clinical import ratios
from epiwake.operators.active import daily_states
from epiwake.tables import Tables

FAR = "9999-12-31"


def with_regions(states: DataFrame, geodata: DataFrame) -> DataFrame:
    """Repeat each state for every region its visit has a point in."""
    return states.join(geodata.select("visit_id", "region_type").distinct(), "visit_id")


def trend_by_day(
    states: DataFrame, spans: DataFrame, days: DataFrame, keys: tuple[str, ...] = ("disease_id",)
) -> DataFrame:
    """Current and previous window counts for each (keys, diagnosis_date) in ``days``.

    ``spans`` has lookback_days and baseline_window_days per disease. An infected state counts
    for every window end from its own date until its next visit or until it drops out of the
    window, so it adds one +1 and one -1; the previous window is the same thing with the
    baseline width, moved forward by lookback + 1 days. What reaches the running sum is one
    row per key and calendar day.
    """
    width, base = F.col("lookback_days"), F.col("baseline_window_days")
    day, following = F.col("diagnosis_date"), F.coalesce("next_date", F.lit(FAR).cast("date"))
    shift = width + 1
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def change(on: Column, current: Column, previous: Column) -> Column:
        return F.struct(on.alias("on"), current.alias("cur"), previous.alias("prev"))

    changes = F.array(
        change(day, one, zero),
        change(F.least(following, F.date_add(day, width + 1)), -one, zero),
        change(F.date_add(day, shift), zero, one),
        change(F.date_add(F.least(following, F.date_add(day, base + 1)), shift), zero, -one),
    )
    # Equal (date, next date) pairs collapse before they are expanded.
    counted = states.filter("infected").groupBy(*keys, "diagnosis_date", "next_date").agg(
        F.count(F.lit(1)).alias("n")
    )
    steps = (
        counted.join(spans.select("disease_id", "lookback_days", "baseline_window_days"), "disease_id")
        .select(*keys, "n", F.explode(changes).alias("c"))
        .groupBy(*keys, F.col("c.on").alias("diagnosis_date"))
        .agg(F.sum(F.col("c.cur") * F.col("n")).alias("cur"), F.sum(F.col("c.prev") * F.col("n")).alias("prev"))
        .withColumn("asked", F.lit(0))
    )
    asked = days.select(*keys, "diagnosis_date").distinct().select(
        *keys, "diagnosis_date", zero.alias("cur"), zero.alias("prev"), F.lit(1).alias("asked")
    )
    up_to = Window.partitionBy(*keys).orderBy("diagnosis_date").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    series = (
        steps.unionByName(asked)
        .groupBy(*keys, "diagnosis_date")
        .agg(F.sum("cur").alias("cur"), F.sum("prev").alias("prev"), F.max("asked").alias("asked"))
        .select(
            *keys, "diagnosis_date", "asked",
            F.sum("cur").over(up_to).alias("current_count"),
            F.sum("prev").over(up_to).alias("previous_count"),
        )
    )
    growth, surge = ratios(F.col("current_count"), F.col("previous_count"))
    return series.filter("asked = 1").select(
        *keys, "diagnosis_date", "current_count", "previous_count",
        growth.alias("growth_rate"), surge.alias("surge_ratio"),
    )


def trend_snapshots(t: Tables, policies: DataFrame, region: bool = False) -> DataFrame:
    """Trend of every (disease[, region], date) that has a visit."""
    states = daily_states(t.visit)
    if not region:
        return trend_by_day(states, policies, t.visit.select("disease_id", "diagnosis_date"))
    located = with_regions(states, t.geodata)
    keys = ("disease_id", "region_type")
    days = t.visit.select(F.col("id").alias("visit_id"), "disease_id", "diagnosis_date").join(
        t.geodata.select("visit_id", "region_type"), "visit_id"
    )
    return trend_by_day(located, policies, days, keys)


def count_cases(t: Tables, windows: DataFrame, region: str | None = None) -> DataFrame:
    """Active visits in arbitrary windows (disease_id, start_date, end_date).

    The windows are few and any length, so states are first reduced to one row per
    (disease, date, next date) and each window is spelled out as its days.
    """
    states = daily_states(t.visit).filter("infected")
    if region is not None:
        located = t.geodata.filter(F.col("region_type") == region).select("visit_id").distinct()
        states = states.join(located, "visit_id", "left_semi")
    reduced = states.groupBy("disease_id", F.col("diagnosis_date").alias("day"), "next_date").agg(
        F.count(F.lit(1)).alias("n")
    )
    reversed_window = F.raise_error(F.lit("start_date lies after end_date")).cast("date")
    first = F.when(F.col("start_date") > F.col("end_date"), reversed_window).otherwise(F.col("start_date"))
    wanted = windows.select("disease_id", "start_date", "end_date").distinct()
    spelled = wanted.select("*", F.explode(F.sequence(first, F.col("end_date"))).alias("day"))
    still = F.col("next_date").isNull() | (F.col("next_date") > F.col("end_date"))
    counted = (
        spelled.join(reduced, ["disease_id", "day"], "left")
        .groupBy("disease_id", "start_date", "end_date")
        .agg(F.coalesce(F.sum(F.when(still, F.col("n"))), F.lit(0).cast("long")).alias("case_count"))
    )
    return windows.join(counted, ["disease_id", "start_date", "end_date"])


def trend(t: Tables, windows: DataFrame, region: str | None = None) -> DataFrame:
    """Compare a current and a previous window per row of ``windows``.

    Columns: disease_id, current_start, current_end, previous_start, previous_end.
    """
    def side(name: str) -> DataFrame:
        return windows.select(
            "disease_id", F.col(f"{name}_start").alias("start_date"), F.col(f"{name}_end").alias("end_date")
        )

    both = side("current").unionByName(side("previous")).distinct()
    counts = count_cases(t, both, region)

    def named(name: str) -> DataFrame:
        return counts.select(
            "disease_id", F.col("start_date").alias(f"{name}_start"),
            F.col("end_date").alias(f"{name}_end"), F.col("case_count").alias(f"{name}_count"),
        )

    growth, surge = ratios(F.col("current_count"), F.col("previous_count"))
    return (
        windows.join(named("current"), ["disease_id", "current_start", "current_end"])
        .join(named("previous"), ["disease_id", "previous_start", "previous_end"])
        .withColumns({"growth_rate": growth, "surge_ratio": surge})
    )
