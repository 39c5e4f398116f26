"""Connected components of an edge table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) of every node in edges (u long, v long); empty for no edges.

    Each step links neighbours to the smallest node around them (Kiveris et al., Connected Components in MapReduce and
    Beyond). Every step is a written table, and only its row count and a sum of hashes come to the driver. A node's
    neighbours are never gathered: the smallest comes from an aggregate and goes back by a join, which Spark can split.
    """
    spark = edges.sparkSession
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        both = edges.union(edges.select("v", "u"))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "stars")
        large = edges.union(edges.select("v", "u").toDF("u", "v")).where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large.where("u <> v"), "large-stars")
        dropped(spark, edges, least)
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "stars")
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = written(small, "small-stars")
        dropped(spark, large, least)
        state = tuple(edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components not found in {max_rounds} rounds")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
