"""Registered queries that have to cover all their input."""

from fieldloom.operators import raster
from fieldloom.plans import bridge, registry
from pyspark.sql import functions as F


def test_every_polygon_has_a_support(spark, sf_dir):
    polygons = {r.poly_id for r in bridge.edges(spark, sf_dir).select("poly_id").distinct().collect()}
    got = {r.poly_id for r in registry.QUERIES["polygon_support"](spark, sf_dir).collect()}
    assert len(polygons) == 25 and got == polygons


def test_empty_windows_of_all_cells(spark, sf_dir):
    cells = registry.QUERIES["empty_windows"](spark, sf_dir).select("site_id", "r", "c").distinct()
    whole = bridge.pixels(spark, sf_dir).select("site_id", "r", "c").distinct()
    assert cells.count() == whole.count() > 1000
    # a site has a value in its first window by one cell alone, and none in the last
    rows = [(1, 1, 1, "2021-01-01", 0.5), (1, 1, 2, "2021-01-01", None), (1, 1, 2, "2021-02-10", 0.4), (1, 1, 1, "2021-03-30", None)]
    px = spark.createDataFrame(rows, "site_id int, r int, c int, d string, v double").withColumn("scene_date", F.to_date("d"))
    assert [tuple(x) for x in raster.empty_windows(px, "v", "2021-01-01", "2021-04-01", 3).collect()] == [(1, 3)]
    by_cell = raster.empty_windows(px, "v", "2021-01-01", "2021-04-01", 3, ("site_id", "r", "c"))
    assert sorted(tuple(x) for x in by_cell.collect()) == [(1, 1, 1, 2), (1, 1, 1, 3), (1, 1, 2, 1), (1, 1, 2, 3)]
