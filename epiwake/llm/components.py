"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Steps


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (a > b).

    Large: every larger neighbour of a node is linked to the smallest of the node and its
    neighbours. Small: a node and its smaller neighbours are linked to the smallest of these.
    The minimum per node is pre-aggregated, and a hub's rows meet one row in the join, which
    adaptive execution may split.
    """
    if large:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = near.join(least, "u")
    if large:
        linked = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        linked = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return linked.where("a <> b").distinct()


def connected_components(edges: DataFrame, steps: Steps) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); the component is its smallest node.

    Nodes without an edge to another node are left out. Steps alternate until the edges no
    longer change; each is stored, so a lost executor costs one step.
    """
    current = steps.save(
        edges.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct(), "edges")
    state = None
    while True:
        stored = steps.save(_star(_star(current, large=True), large=False), "star")
        steps.drop(current)
        current = stored
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return (
        current.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
        .unionAll(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    )
