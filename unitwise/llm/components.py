"""Connected components by alternating large-star and small-star steps, one staged table a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitwise.session import stage


def _with_least(pairs: DataFrame) -> DataFrame:
    """``pairs`` (u, v) with the least of u and its neighbours as m."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return pairs.join(least, "u")


def _round(edges: DataFrame) -> DataFrame:
    """(u, v) with u > v to the edges after one large-star and one small-star step."""
    both = edges.select(F.explode(F.array(
        F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
    large = _with_least(both).filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    small = _with_least(large).select(F.explode(F.array(
        F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
    return small.select("e.*").filter("u <> v").distinct()


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Does every node have one edge up, to a node that has none?"""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))).alias("e"))
    return ends.groupBy("e.x").agg(F.sum("e.up").alias("up"), F.min("e.up").alias("least")).filter(
        "up > 1 OR up = 1 AND least = 0").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); a component is named by its least node.

    Nulls and loops are no edges; an empty table has no components.
    """
    now = stage(edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _is_forest_of_stars(now):
        now = stage(_round(now))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
