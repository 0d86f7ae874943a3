"""Connected components of a large graph, as DataFrame rounds over written edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, saved


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node with an edge.

    edges: (u, v) longs; direction, repeats and loops do not matter, rows with a null
    are ignored. Alternates large-star and small-star steps until nothing changes; a
    round groups by node with map-side minimums, so that a hub costs one row per task,
    and its edges are written before the next round reads them.
    """
    spark = edges.sparkSession
    own = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current, path = saved(own, "links")
    before = None
    while True:
        state = _state(current)
        if state == before or state[0] == 0:
            break
        before = state
        larger, large_path = saved(_large_star(current), "links")
        smaller, small_path = saved(_small_star(larger), "links")
        discard(spark, [path, large_path])
        current, path = smaller, small_path
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(current.select("v", "v").distinct())


def _state(edges: DataFrame) -> tuple:
    """What two equal edge sets agree on: count and an order-free 128-bit sum."""
    return tuple(edges.agg(
        F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(20, 0)))"), F.expr("bit_xor(xxhash64(v, u))")).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
        least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
