"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(a long, b long) edges -> (node long, root long), a row for each node that has an edge; root is the smallest node reachable.

    Every step is a join of the edges with the smallest neighbour of each node. That table is
    written first, so that both sides of the join are plain exchanges and AQE can split the node
    that holds most edges. Null ends and loops are ignored; no edges give no rows.
    """
    edges = edges.where("a is not null and b is not null and a <> b")
    now, path = scratch.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = now.union(now.select("v", "u")).toDF("u", "v")
        low, low_path = scratch.write(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large, large_path = scratch.write(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low2, low2_path = scratch.write(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low2, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low2)
        after, after_path = scratch.write(small.distinct())
        for old in (path, low_path, large_path, low2_path):
            scratch.drop(old)
        now, path = after, after_path
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("low"), F.lit(0).alias("top")).union(now.select("v", F.lit(0), F.lit(1)))
        roles = ends.groupBy("node").agg(F.sum("low").alias("low"), F.max("top").alias("top"))
        if not roles.where("low + top > 1").take(1):  # done: every node has one edge, to a root that has none
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())
