"""Connected components on DataFrames by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .runtime import drop_tables, materialize


def _state(edges: DataFrame) -> tuple:
    """Enough to tell whether a round changed the edge set."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges: (u long, v long), any direction. Returns (id, component) with component the smallest id reachable, for every id in an edge.

    Each round is two aggregations and joins over the edges; hubs are pre-aggregated (min) and joins on hubs can be split.
    Rounds grow with the logarithm of the longest path.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        mid = materialize(large, "edges")
        least = mid.groupBy("u").agg(F.min("v").alias("m"))
        small = mid.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop_tables(now, mid)
        now, before, seen = after, seen, _state(after)
        if before == seen:
            break
    roots = now.groupBy("v").agg(F.first("v").alias("component")).select(F.col("v").alias("id"), "component")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
