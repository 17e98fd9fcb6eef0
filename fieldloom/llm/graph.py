"""Connected components of an edge table by alternating large-star and small-star rounds; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, spread_join, written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step.  edges: (u, v) with u > v.  The minimum of a node is pre-aggregated; AQE can split the edges of a hot node."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("m"))
    joined = spread_join(both.withColumnRenamed("u", "node"), least, ["node"]).select(F.col("node").alias("u"), "v", "m")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("node").alias("u"), F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of an edge and the smallest node it can reach.  edges: (u, v) of comparable values, in any direction.

    Each round is a table in the shared folder; the loop ends when a round changes nothing.
    """
    edges = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, mark = written(edges, "edges"), None
    while True:
        after = written(_stars(_stars(now, True), False), "edges")
        state = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_written(now)
        now = after
        if state == mark or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = state
