"""Boolean grids as rows of cells: extents, envelopes, ranks, bridges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def perimeter(cells: DataFrame) -> DataFrame:
    """First and last cell of every row and column of an area (site_id, label, r, c)."""
    row, column = Window.partitionBy("site_id", "label", "r"), Window.partitionBy("site_id", "label", "c")
    ends = (F.col("c") == F.min("c").over(row)) | (F.col("c") == F.max("c").over(row)) | (F.col("r") == F.min("r").over(column)) | (F.col("r") == F.max("r").over(column))
    return cells.withColumn("_end", ends).where("_end").drop("_end")


def envelope(cells: DataFrame, size: int) -> DataFrame:
    """(site_id, label, axis, line, low, high): one cell beyond an area in every row ('r') and column ('c'), clamped."""
    one = lambda a, b: cells.groupBy("site_id", "label", F.col(a).alias("line")).agg(F.greatest(F.min(b) - 1, F.lit(1)).alias("low"), F.least(F.max(b) + 1, F.lit(size)).alias("high")).select("site_id", "label", F.lit(a).alias("axis"), "line", "low", "high")
    return one("r", "c").unionByName(one("c", "r"))


def ranked(cells: DataFrame, seeds: DataFrame) -> DataFrame:
    """(site_id, label, size, min_dist, area_num): areas by Chebyshev distance to the seed, then size, then label."""
    far = F.greatest(F.abs(F.col("r") - F.col("r0")), F.abs(F.col("c") - F.col("c0")))
    out = cells.join(seeds.select("site_id", "r0", "c0"), "site_id").groupBy("site_id", "label").agg(F.count(F.lit(1)).alias("size"), F.min(far).alias("min_dist"))
    order = Window.partitionBy("site_id").orderBy("min_dist", F.col("size").desc(), "label")
    return out.withColumn("area_num", F.row_number().over(order))


def neighbours(cells: DataFrame) -> DataFrame:
    """Every cell once for each of its eight neighbours, with that neighbour's place (nr, nc): eight rows for one."""
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j))
    return cells.withColumn("_s", F.explode(steps)).withColumns({"nr": F.col("r") + F.col("_s.i"), "nc": F.col("c") + F.col("_s.j")}).drop("_s")


def bridges(cells: DataFrame, dead: DataFrame) -> DataFrame:
    """Dead cells (site_id, r, c) that touch two or more labels."""
    touch = neighbours(cells).select("site_id", F.col("nr").alias("r"), F.col("nc").alias("c"), "label")
    return touch.join(dead, ["site_id", "r", "c"], "left_semi").groupBy("site_id", "r", "c").agg(F.count_distinct("label").alias("labels")).where("labels >= 2")
