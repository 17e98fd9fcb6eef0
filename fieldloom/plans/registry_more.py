"""Queries of the retrieval chain, georeferenced grids, polygons, batch rounds and the SQL surface, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import boundaries, delineate, georef, retrieval, series
from ..streaming.series import streaming_series
from . import batch, bridge, sql
from .params import params
from .registry import ALIVE, EDGES, EVI2, FX, MASK, PX, RASTER, SITES, SIZE, VISITS, VX, WINDOWS, _NEAR8, _labels_sql, alive, features, mask_cells, query, rounded, seeds, values, visits
from .session import shared_folder

# -- grids -----------------------------------------------------------------------------------------

GRIDS_SQL = """
SELECT CAST(s_suppkey AS BIGINT) AS site_id, s_nationkey AS nation, 32750 AS epsg, CAST(s_suppkey % 7 + 3 AS INT) AS nrow, CAST(s_suppkey % 5 + 4 AS INT) AS ncol,
  CAST(400000 + s_suppkey * 35 AS DOUBLE) AS xmin, CAST(6400000 + s_suppkey * 25 AS DOUBLE) AS ymax, CASE WHEN s_suppkey % 3 = 0 THEN CAST(20 AS DOUBLE) ELSE CAST(10 AS DOUBLE) END AS res_x,
  CASE WHEN s_suppkey % 3 = 0 THEN CAST(20 AS DOUBLE) ELSE CAST(10 AS DOUBLE) END AS res_y, CAST(400000 + s_suppkey * 35 + s_suppkey * 13 % 120 - 10 AS DOUBLE) AS x, CAST(6400000 + s_suppkey * 25 - s_suppkey * 17 % 130 + 10 AS DOUBLE) AS y
FROM supplier"""
GRIDS = f"gr AS ({GRIDS_SQL})"


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.derived(spark, sf_dir, GRIDS_SQL)


@query(
    "grid_cells",
    f"""WITH {GRIDS}, p AS (SELECT *, CASE WHEN y = ymax - nrow * res_y THEN nrow ELSE floor((ymax - y) / res_y) + 1 END AS r, CASE WHEN x = xmin + ncol * res_x THEN ncol ELSE floor((x - xmin) / res_x) + 1 END AS c FROM gr),
q AS (SELECT *, r BETWEEN 1 AND nrow AND c BETWEEN 1 AND ncol AS inside FROM p)
SELECT site_id, CASE WHEN inside THEN CAST(r AS INT) ELSE -1 END AS r0, CASE WHEN inside THEN CAST(c AS INT) ELSE -1 END AS c0, CASE WHEN inside THEN CAST(least(r - 1, nrow - r, c - 1, ncol - c) AS INT) ELSE -1 END AS rmax,
  CASE WHEN inside THEN CAST((r - 1) * ncol + c AS BIGINT) ELSE -1 END AS cell, CASE WHEN inside THEN CAST(r AS INT) ELSE -1 END AS row_back, CASE WHEN inside THEN CAST(c AS INT) ELSE -1 END AS col_back FROM q""",
)
def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed cells and limits, cell numbers and back; -1 for points outside."""
    own = grids(spark, sf_dir)
    found = georef.seeds(own, own.drop("x", "y")).join(own.select("site_id", "nrow", "ncol"), "site_id")
    found = found.withColumn("cell", georef.cell_number(F.col("r0"), F.col("c0")))
    found = found.select("site_id", "r0", "c0", "rmax", "cell", georef.row_of(F.col("cell")).alias("row_back"), georef.column_of(F.col("cell")).alias("col_back"))
    return found.na.fill(-1)


@query("grid_extent", f"WITH {GRIDS} SELECT site_id, xmin, xmin + ncol * res_x AS xmax, ymax - nrow * res_y AS ymin, ymax FROM gr")
def grid_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids(spark, sf_dir).select("site_id", georef.extent().alias("e")).select("site_id", "e.*")


@query(
    "grid_union",
    f"""WITH {GRIDS}, m AS (SELECT nation, arg_min({{'xmin': xmin, 'ymax': ymax, 'res': res_x}}, {{'a': xmin, 'b': -ymax, 'c': res_x}}) AS g, max(xmin + ncol * res_x) AS x2, min(ymax - nrow * res_y) AS y1, max(ymax) AS y2 FROM gr GROUP BY nation),
t AS (SELECT *, g.ymax + ceil(round((y2 - g.ymax) / g.res, 6)) * g.res AS top FROM m)
SELECT nation, CAST(ceil(round((top - y1) / g.res, 6)) AS INT) AS nrow, CAST(ceil(round((x2 - g.xmin) / g.res, 6)) AS INT) AS ncol, g.xmin AS xmin, top AS ymax, g.res AS res_x FROM t""",
)
def grid_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return georef.union_grid(grids(spark, sf_dir), ("nation",)).select("nation", "nrow", "ncol", "xmin", "ymax", "res_x")


@query("grid_same", f"WITH {GRIDS} SELECT site_id, site_id % 4 < 2 AS same FROM gr")
def grid_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids against themselves: as they are, moved by a millionth of a metre, by half a cell, and with one more row."""
    kind = F.col("site_id") % 4
    moved = {"xmin": F.col("xmin") + F.when(kind == 1, 1e-6).when(kind == 2, 5.0).otherwise(0.0), "nrow": F.col("nrow") + F.when(kind == 3, 1).otherwise(0)}
    own = grids(spark, sf_dir)
    both = own.select("site_id", F.struct(*georef.GRID).alias("a")).join(own.withColumns(moved).select("site_id", F.struct(*georef.GRID).alias("b")), "site_id")
    return both.select("site_id", georef.same_geometry("a", "b").alias("same"))


def site_grids(spark: SparkSession) -> DataFrame:
    """The grid of each site of the pixel view, ten metres a cell."""
    east = F.col("id") * 1000.0
    return spark.range(5).select(F.col("id").cast("int").alias("site_id"), F.lit(32750).alias("epsg"), F.lit(SIZE).alias("nrow"), F.lit(SIZE).alias("ncol"), east.alias("xmin"), F.lit(2000.0).alias("ymax"), F.lit(10.0).alias("res_x"), F.lit(10.0).alias("res_y"))


def _site_boxes(spark: SparkSession) -> DataFrame:
    east = F.col("site_id") * 1000.0
    return site_grids(spark).select("site_id", F.struct((east + 33.0 - F.col("site_id") * 20).alias("xmin"), F.lit(1850.5).alias("ymin"), (east + 121.0).alias("xmax"), F.lit(1931.0).alias("ymax")).alias("box"))


@query("crop_outward", f"WITH {PX} SELECT site_id, r, c, count(*) AS n FROM px WHERE r BETWEEN 7 AND 15 AND c BETWEEN greatest(1, floor((33 - site_id * 20) / 10.0) + 1) AND 13 GROUP BY ALL")
def crop_outward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that the requested box touches."""
    return georef.cropped(bridge.pixels(spark, sf_dir), site_grids(spark), _site_boxes(spark)).groupBy("site_id", "r", "c").agg(F.count(F.lit(1)).alias("n"))


@query("crop_grid", "SELECT CAST(i AS INT) AS site_id, 9 AS nrow, CAST(13 - greatest(1, floor((33 - i * 20) / 10.0) + 1) + 1 AS INT) AS ncol, i * 1000.0::DOUBLE + (greatest(1, floor((33 - i * 20) / 10.0) + 1) - 1) * 10.0::DOUBLE AS xmin, 1940.0::DOUBLE AS ymax FROM range(5) t(i)")
def crop_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return georef.cropped_grid(site_grids(spark), _site_boxes(spark)).select("site_id", "nrow", "ncol", "xmin", "ymax")


@query(
    "trim_cells",
    f"""WITH {FX}, k AS (SELECT site_id, r, c, CASE WHEN w1 >= 0.8 THEN w1 END AS v FROM feat), b AS (SELECT site_id, min(r) AS r1, max(r) AS r2, min(c) AS c1, max(c) AS c2 FROM k WHERE v IS NOT NULL GROUP BY ALL)
SELECT k.site_id, r, c, round(v, 9) AS v FROM k JOIN b USING (site_id) WHERE r BETWEEN r1 AND r2 AND c BETWEEN c1 AND c2""",
)
def trim_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = features(spark, sf_dir).select("site_id", "r", "c", F.when(F.col("w1") >= 0.8, F.col("w1")).alias("v"))
    return rounded(georef.trimmed(own, "v"), "v")


_TARGET = f"""tg AS (SELECT CAST(i AS INT) AS site_id, CAST(a.r AS INT) AS r, CAST(b.c AS INT) AS c, (2000.0::DOUBLE - ((2004.0::DOUBLE) - (a.r - 0.5::DOUBLE) * 15)) / 10 + 0.5 AS fr, ((i * 1000.0::DOUBLE + 7) + (b.c - 0.5::DOUBLE) * 15 - i * 1000.0::DOUBLE) / 10 + 0.5 AS fc
  FROM range(5) t(i), range(1, 15) a(r), range(1, 15) b(c)), mx AS (SELECT site_id, r, c, max(nir) AS v FROM px WHERE qa < 3 GROUP BY ALL)"""


def _moved_grids(spark: SparkSession) -> DataFrame:
    return site_grids(spark).withColumns({"xmin": F.col("xmin") + 7, "ymax": F.col("ymax") + 4, "res_x": F.lit(15.0), "res_y": F.lit(15.0), "nrow": F.lit(14), "ncol": F.lit(14)})


def _highest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.pixels(spark, sf_dir).where("qa < 3").groupBy("site_id", "r", "c").agg(F.max("nir").alias("v"))


@query(
    "project_bilinear",
    f"""WITH {PX}, {_TARGET}, w AS (SELECT tg.site_id, tg.r, tg.c, mx.v, (1 - abs(fr - mx.r)) * (1 - abs(fc - mx.c)) AS w FROM tg JOIN mx ON mx.site_id = tg.site_id AND mx.r BETWEEN floor(fr) AND floor(fr) + 1 AND mx.c BETWEEN floor(fc) AND floor(fc) + 1)
SELECT site_id, r, c, round(sum(v * w) / sum(w), 9) AS v FROM w WHERE w > 0 GROUP BY ALL""",
)
def project_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(georef.projected(_highest(spark, sf_dir), ["v"], site_grids(spark), _moved_grids(spark)), "v")


@query("project_near", f"WITH {PX}, {_TARGET} SELECT tg.site_id, tg.r, tg.c, round(mx.v, 9) AS v FROM tg JOIN mx ON mx.site_id = tg.site_id AND mx.r = floor(fr + 0.5) AND mx.c = floor(fc + 0.5)")
def project_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(georef.projected(_highest(spark, sf_dir), ["v"], site_grids(spark), _moved_grids(spark), "near"), "v")


@query("utm_roundtrip", f"WITH {SITES} SELECT site_id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM sites WHERE lat BETWEEN -80 AND 84")
def utm_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To UTM and back."""
    own = bridge.sites(spark, sf_dir).withColumn("epsg", geo.utm_epsg(F.col("lon"), F.col("lat"))).where("epsg is not null")
    there = geo.with_xy(own, F.col("lon"), F.col("lat"), F.col("epsg"))
    back = geo.with_lonlat(there, F.col("x"), F.col("y"), F.col("epsg"), "lon2", "lat2")
    lon, lat = F.col("lon2"), F.col("lat2")
    lon = F.when(F.abs(lon - F.col("lon")) > 180, lon - 360 * F.signum(lon)).otherwise(lon)  # the zone east of the antimeridian
    return rounded(back.select("site_id", lon.alias("lon"), lat.alias("lat")), "lon", "lat", digits=6)


_E = math.sqrt(geo.E2)
_BAND = f"({geo.A * geo.A * (1 - geo.E2) / 2!r}::DOUBLE * (sin(radians({{l}})) / (1 - {geo.E2!r}::DOUBLE * sin(radians({{l}})) * sin(radians({{l}}))) + atanh({_E!r}::DOUBLE * sin(radians({{l}}))) / {_E!r}::DOUBLE))"


@query(
    "cell_expanse",
    f"""WITH {PX}, {MASK} SELECT site_id, area_num, round(sum(({_BAND.format(l="(-30.0::DOUBLE - (r - 1) * 0.001::DOUBLE)")} - {_BAND.format(l="(-30.0::DOUBLE - r * 0.001::DOUBLE)")}) * radians(0.001::DOUBLE)), 2) AS area FROM mask GROUP BY ALL""",
)
def cell_expanse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Square metres of areas on a geographic grid."""
    own = site_grids(spark).withColumns({"epsg": F.lit(4326), "ymax": F.lit(-30.0), "xmin": F.lit(117.0), "res_x": F.lit(0.001), "res_y": F.lit(0.001)})
    return rounded(georef.expanse(mask_cells(spark, sf_dir), own, ("site_id", "area_num")), "area", digits=2)


@query(
    "search_padding",
    f"""WITH {SITES} SELECT site_id, round(greatest(lon - 0.02 - 5000 / 111320.0::DOUBLE, -180.0::DOUBLE), 9) AS xmin, round(greatest(lat - 0.02 - 5000 / 111320.0::DOUBLE, -90.0::DOUBLE), 9) AS ymin,
  round(least(lon + 0.02 + 5000 / 111320.0::DOUBLE, 180.0::DOUBLE), 9) AS xmax, round(least(lat + 0.02 + 5000 / 111320.0::DOUBLE, 90.0::DOUBLE), 9) AS ymax FROM sites""",
)
def search_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = F.col("lon"), F.col("lat")
    box = F.struct((lon - 0.02).alias("xmin"), (lat - 0.02).alias("ymin"), (lon + 0.02).alias("xmax"), (lat + 0.02).alias("ymax"))
    own = bridge.sites(spark, sf_dir).withColumn("box", box).select("site_id", geo.padded(F.col("box")).alias("b")).select("site_id", "b.*")
    return rounded(own, "xmin", "ymin", "xmax", "ymax")


# -- retrieval -------------------------------------------------------------------------------------

#: Catalogue entries of five sites and of a place far away; some without, with an empty or with an unreadable datetime.
ITEMS_SQL = """
SELECT o_orderkey AS item_id, CASE WHEN o_orderkey % 29 = 0 THEN 'n/a' WHEN o_orderkey % 17 = 0 THEN '' WHEN o_orderkey % 19 = 0 THEN NULL ELSE concat(CAST(CAST(o_orderdate AS DATE) + 6574 AS STRING), 'T02:10:05.120Z') END AS datetime,
  concat(CAST(CAST(o_orderdate AS DATE) + 6574 AS STRING), 'T01:00:00Z') AS start_datetime, CASE WHEN o_custkey % 2 = 0 THEN 'sentinel-2a' ELSE 'sentinel-2b' END AS platform, CAST(CAST(floor(o_totalprice) AS BIGINT) % 101 AS DOUBLE) AS cloud,
  CAST(o_custkey % 6 AS INT) AS place, concat('T50H', CAST(o_custkey % 3 AS STRING)) AS mgrs_tile, CAST(o_custkey % 2 AS INT) AS relative_orbit, CASE o_orderkey % 3 WHEN 0 THEN '05.10' WHEN 1 THEN '02.04' END AS baseline, o_orderpriority AS generation
FROM orders"""
DN_SQL = """
SELECT l_orderkey AS item_id, CAST(l_partkey % 6 + 1 AS INT) AS r, CAST(l_suppkey % 6 + 1 AS INT) AS c, max(CAST(floor((0.10 + l_quantity / 200.0) * 10000) AS BIGINT) + CASE WHEN l_orderkey % 3 = 0 THEN 1000 ELSE 0 END) AS nir,
  max(CAST(floor((0.02 + l_discount) * 10000) AS BIGINT) + CASE WHEN l_orderkey % 3 = 0 THEN 1000 ELSE 0 END) AS red, max(CAST(l_linenumber AS BIGINT)) AS scl
FROM lineitem WHERE l_orderkey % 23 <> 0 GROUP BY l_orderkey, CAST(l_partkey % 6 + 1 AS INT), CAST(l_suppkey % 6 + 1 AS INT)"""
_FIRST, _LAST = "2015-07-01", "2017-06-30"
_ITEMS = f"it AS ({ITEMS_SQL}), dt AS (SELECT *, TRY_CAST(substr(coalesce(CASE WHEN datetime <> '' THEN datetime END, start_datetime), 1, 10) AS DATE) AS scene_date FROM it)"
_NEAR_ITEMS = f"""{_ITEMS}, ni AS (SELECT place AS site_id, * FROM dt WHERE scene_date BETWEEN DATE '{_FIRST}' AND DATE '{_LAST}' AND cloud <= 50 AND place < 5)"""
#: The instant decides only where it can be read; an item without one is an acquisition of its own.
_CHOSEN = f"""{_NEAR_ITEMS}, ki AS (SELECT *, CASE WHEN datetime LIKE '____-__-__T%' THEN datetime END AS instant, TRY_CAST(split_part(baseline, '.', 1) AS INT) AS major, TRY_CAST(split_part(baseline, '.', 2) AS INT) AS minor FROM ni),
oi AS (SELECT *, max(CASE WHEN major IS NULL OR minor IS NULL THEN 1 ELSE 0 END) OVER w AS open, row_number() OVER (PARTITION BY site_id, platform, mgrs_tile, relative_orbit, instant, CASE WHEN instant IS NULL THEN item_id END ORDER BY major DESC NULLS LAST, minor DESC NULLS LAST, generation IS NULL, generation DESC, item_id) AS k
  FROM ki WINDOW w AS (PARTITION BY site_id, platform, mgrs_tile, relative_orbit, instant, CASE WHEN instant IS NULL THEN item_id END)),
ci AS (SELECT * FROM oi WHERE k = 1 OR open = 1)"""


def places(spark: SparkSession) -> DataFrame:
    return spark.range(5).select(F.col("id").cast("int").alias("site_id"), (117.3 + 2 * F.col("id")).alias("longitude"), F.lit(-32.0).alias("latitude"))


def catalogue_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries with boxes and addresses of their assets."""
    own = bridge.derived(spark, sf_dir, ITEMS_SQL)
    lon = F.when(F.col("place") < 5, 117.3 + 2 * F.col("place")).otherwise(-60.0)
    path = lambda band: F.concat(F.lit("store://scenes/"), F.col("item_id").cast("string"), F.lit(f"/{band}?sig=abc"))
    assets = F.map_from_arrays(F.array(*(F.lit(b) for b in ("B08", "B04", "SCL", "B02"))), F.array(path("B08"), path("B04"), path("SCL"), path("B02")))
    return own.withColumns({"xmin": lon - 0.2, "xmax": lon + 0.2, "ymin": F.lit(-32.2), "ymax": F.lit(-31.8), "assets": assets})


def asset_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(href, r, c, dn) of all assets."""
    own = bridge.derived(spark, sf_dir, DN_SQL)
    bands = F.explode(F.array(*(F.struct(F.lit(a).alias("asset"), F.col(b).alias("dn")) for a, b in (("B08", "nir"), ("B04", "red"), ("SCL", "scl")))))
    each = own.select("item_id", "r", "c", bands.alias("x"))
    return each.select(F.concat(F.lit("store://scenes/"), F.col("item_id").cast("string"), F.lit("/"), F.col("x.asset")).alias("href"), "r", "c", F.col("x.dn").alias("dn"))


def near_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = geo.with_box(places(spark), F.col("longitude"), F.col("latitude"), F.lit(1000.0), F.lit(1000.0)).select("site_id", "box")
    return retrieval.of_sites(retrieval.in_period(catalogue_items(spark, sf_dir), _FIRST, _LAST).where("cloud <= 50"), boxes)


@query("acquisition_days", f"WITH {_ITEMS} SELECT item_id, CAST(scene_date AS VARCHAR) AS day FROM dt WHERE scene_date IS NOT NULL")
def acquisition_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days from datetime, or start_datetime where that is missing or empty; unreadable ones go."""
    own = catalogue_items(spark, sf_dir).select("item_id", retrieval.acquired().alias("d")).where("d is not null")
    return own.select("item_id", F.col("d").cast("string").alias("day"))


@query("site_items", f"WITH {_NEAR_ITEMS} SELECT site_id, item_id, CAST(scene_date AS VARCHAR) AS day FROM ni")
def site_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items over each site in the period and under the cloud limit."""
    return near_items(spark, sf_dir).select("site_id", "item_id", F.col("scene_date").cast("string").alias("day"))


@query("chosen_items", f"WITH {_CHOSEN} SELECT site_id, item_id FROM ci")
def chosen_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.chosen(near_items(spark, sf_dir), "highest_baseline").select("site_id", "item_id")


@query(
    "asset_addresses",
    f"WITH {_NEAR_ITEMS}, b AS (SELECT * FROM (VALUES ('B08'), ('B04')) v(asset)) SELECT item_id, asset, concat('store://scenes/', item_id, '/', asset, '?sig=abc&token=t') AS href, concat('store://scenes/', item_id, '/', asset) AS path FROM ni, b",
)
def asset_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed addresses of the bands that the index needs, and no others."""
    return retrieval.asset_rows(near_items(spark, sf_dir), ["B08", "B04"], "token=t")


@query(
    "dropped_items",
    f"""WITH {_NEAR_ITEMS}, h AS (SELECT DISTINCT l_orderkey AS item_id FROM lineitem WHERE l_orderkey % 23 <> 0), e AS (SELECT ni.site_id, ni.scene_date, ni.item_id, h.item_id IS NULL AS lost FROM ni LEFT JOIN h USING (item_id))
SELECT site_id, count(*) AS items, count(*) FILTER (lost) AS dropped, arg_min(item_id, {{'d': scene_date, 'i': item_id}}) FILTER (lost) AS first_item, CASE WHEN count(*) FILTER (lost) > 0 THEN concat(count(*) FILTER (lost), ' of ', count(*), ' acquisitions dropped') END AS message FROM e GROUP BY ALL""",
)
def dropped_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.unreadable(near_items(spark, sf_dir), asset_pixels(spark, sf_dir), ["B08", "B04"])


_SCENES = f"""{_CHOSEN}, dn AS ({DN_SQL}), cl AS (SELECT ci.site_id, ci.scene_date, ci.item_id, r, c, CASE WHEN scl NOT IN (3, 7) THEN nir - off END AS nir, CASE WHEN scl NOT IN (3, 7) THEN red - off END AS red
  FROM (SELECT *, CASE WHEN TRY_CAST(baseline AS DOUBLE) >= 4 THEN 1000 ELSE 0 END AS off FROM ci) ci JOIN dn USING (item_id)),
rf AS (SELECT site_id, scene_date, item_id, r, c, CASE WHEN nir BETWEEN 1 AND 10000 THEN nir * 0.0001::DOUBLE + 0.0::DOUBLE END AS nir, CASE WHEN red BETWEEN 1 AND 10000 THEN red * 0.0001::DOUBLE + 0.0::DOUBLE END AS red FROM cl),
sc AS (SELECT site_id, scene_date, r, c, arg_min(nir, item_id) FILTER (nir IS NOT NULL) AS nir, arg_min(red, item_id) FILTER (red IS NOT NULL) AS red FROM rf GROUP BY ALL)"""


def retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.scenes(places(spark), catalogue_items(spark, sf_dir), asset_pixels(spark, sf_dir), "sentinel-2", _FIRST, _LAST, ("EVI2",), mask=[3, 7])


@query("retrieved_scenes", f"WITH {_SCENES} SELECT site_id, CAST(scene_date AS VARCHAR) AS day, r, c, round(nir, 9) AS nir, round(red, 9) AS red, round(CAST({EVI2} AS DOUBLE), 9) AS v FROM sc")
def retrieved_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain: box, search, processing choice, offset, range, mask, mosaic, index."""
    from ..functions import indices

    out = indices.with_index(retrieved(spark, sf_dir), "EVI2", "v")
    return rounded(out.select("site_id", F.col("scene_date").cast("string").alias("day"), "r", "c", "nir", "red", "v"), "nir", "red", "v")


@query(
    "retrieved_series",
    f"WITH {_SCENES}, v AS (SELECT site_id, scene_date, avg(CAST({EVI2} AS DOUBLE)) AS v FROM sc GROUP BY ALL) SELECT site_id, strftime(scene_date, '%Y-%m') AS date, round(avg(v), 9) AS value FROM v WHERE v IS NOT NULL GROUP BY ALL",
)
def retrieved_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..query import get_scenes

    grids_ = places(spark).select("site_id", F.lit(4326).alias("epsg"), F.lit(6).alias("nrow"), F.lit(6).alias("ncol"), (F.col("longitude") - 0.003).alias("xmin"), (F.col("latitude") + 0.003).alias("ymax"), F.lit(0.001).alias("res_x"), F.lit(0.001).alias("res_y"))
    own = get_scenes(places(spark), catalogue_items(spark, sf_dir), asset_pixels(spark, sf_dir), grids_, _FIRST, _LAST, "EVI2", mask=[3, 7])
    return rounded(own.as_time_series("monthly"), "value")


@query(
    "coarse_near_dates",
    f"""WITH {_ITEMS}, f AS (SELECT DISTINCT place AS site_id, scene_date FROM dt WHERE place < 5 AND item_id % 31 = 0 AND scene_date IS NOT NULL), k AS (SELECT place AS site_id, scene_date, item_id FROM dt WHERE place < 5 AND scene_date IS NOT NULL)
SELECT site_id, CAST(scene_date AS VARCHAR) AS day, min(item_id) AS item_id FROM k WHERE EXISTS (SELECT 1 FROM f WHERE f.site_id = k.site_id AND abs(datediff('day', f.scene_date, k.scene_date)) <= 1) GROUP BY ALL""",
)
def coarse_near_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = bridge.derived(spark, sf_dir, ITEMS_SQL).withColumn("scene_date", retrieval.acquired()).where("place < 5 and scene_date is not null").select(F.col("place").alias("site_id"), "scene_date", "item_id")
    fine = own.where("item_id % 31 = 0").select("site_id", "scene_date").distinct()
    return retrieval.coarse_near(fine, own).select("site_id", F.col("scene_date").cast("string").alias("day"), "item_id")


@query("catalogue_json", f"WITH {_ITEMS} SELECT item_id, platform, cloud, CAST(scene_date AS VARCHAR) AS day FROM dt")
def catalogue_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries through JSON text, as a catalogue's answers come."""
    from ..sources.catalogue import items_from_json

    own = bridge.derived(spark, sf_dir, ITEMS_SQL)
    text = F.to_json(F.struct(F.col("item_id").cast("string").alias("id"), F.struct("datetime", "start_datetime", "platform", F.col("cloud").alias("eo:cloud_cover")).alias("properties")))
    out = items_from_json(own.select(text.alias("text")))
    return out.select(F.col("item_id").cast("long").alias("item_id"), "platform", "cloud", retrieval.acquired().cast("string").alias("day"))


# -- polygons --------------------------------------------------------------------------------------


@query(
    "rasterise_touch",
    f"""WITH {EDGES}, {RASTER}, g AS (SELECT CAST(a.i AS INT) AS r, CAST(b.i AS INT) AS c FROM range(1, {SIZE + 1}) a(i), range(1, {SIZE + 1}) b(i)),
x AS (SELECT DISTINCT site_id, poly_id, r, c FROM edges JOIN g ON greatest(x1, x2) > c - 1 AND least(x1, x2) < c AND greatest(y1, y2) > r - 1 AND least(y1, y2) < r)
SELECT DISTINCT site_id, poly_id, r, c FROM (SELECT * FROM rst UNION ALL SELECT * FROM x)""",
)
def rasterise_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that a polygon touches (its edges are level or upright)."""
    return boundaries.touched(bridge.edges(spark, sf_dir), SIZE)


@query(
    "polygon_shrunk",
    f"""WITH {EDGES}, {RASTER}, d AS (SELECT k.site_id, k.poly_id, k.r, k.c, min(pow(k.c - 0.5 - greatest(least(x1, x2), least(greatest(x1, x2), k.c - 0.5)), 2) + pow(k.r - 0.5 - greatest(least(y1, y2), least(greatest(y1, y2), k.r - 0.5)), 2)) AS d
  FROM rst k JOIN edges e ON e.poly_id = k.poly_id GROUP BY ALL) SELECT site_id, poly_id, r, c FROM d WHERE d >= 1.5 * 1.5""",
)
def polygon_shrunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A buffer of one and a half cells inward."""
    return boundaries.shrunk(bridge.edges(spark, sf_dir), SIZE, 1.5)


_SIDES = "d AS (SELECT * FROM (VALUES (0, -1, 0, 0, 1, 0), (1, 0, 1, 0, 1, 1), (0, 1, 1, 1, 0, 1), (-1, 0, 0, 1, 0, 0)) v(dc, dr, a, b, e, f))"


@query(
    "mask_dissolved",
    f"""WITH {FX}, {ALIVE}, {_SIDES} SELECT m.site_id, m.c - 1 + a AS x1, m.r - 1 + b AS y1, m.c - 1 + e AS x2, m.r - 1 + f AS y2 FROM al m, d WHERE NOT EXISTS (SELECT 1 FROM al n WHERE n.site_id = m.site_id AND n.r = m.r + d.dr AND n.c = m.c + d.dc)""",
)
def mask_dissolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The border of all areas of a site together."""
    cells = delineate.labelled(alive(spark, sf_dir), seeds(spark), SIZE, SIZE, True)
    return boundaries.dissolved(cells, ["site_id"])


@query(
    "mask_measures",
    f"""WITH RECURSIVE {FX}, {ALIVE}, {_labels_sql(_NEAR8)}, {_SIDES}, n AS (SELECT site_id, label, count(*) AS n FROM lb GROUP BY ALL),
b AS (SELECT m.site_id, m.label, count(*) AS k FROM lb m, d WHERE NOT EXISTS (SELECT 1 FROM lb n WHERE n.site_id = m.site_id AND n.label = m.label AND n.r = m.r + d.dr AND n.c = m.c + d.dc) GROUP BY ALL)
SELECT n.site_id, n.label, CAST(n AS DOUBLE) AS area, CAST(k AS DOUBLE) AS length FROM n JOIN b USING (site_id, label)""",
)
def mask_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area and length of every area's outline."""
    cells = delineate.labelled(alive(spark, sf_dir), seeds(spark), SIZE, SIZE)
    return boundaries.measured(boundaries.outlines(cells, ["site_id", "label"]), ["site_id", "label"])


@query("mask_rings")
def mask_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed rings of every area as text; tests read them back."""
    cells = delineate.labelled(alive(spark, sf_dir), seeds(spark), SIZE, SIZE)
    return boundaries.ring_texts(boundaries.outlines(cells, ["site_id", "label"]), ["site_id", "label"])


@query(
    "polygon_of_point",
    f"""WITH {EDGES}, b AS (SELECT poly_id, min(x1) AS x1, max(x1) AS x2, min(y1) AS y1, max(y1) AS y2, abs(sum(x1 * y2 - x2 * y1)) / 2 AS area FROM edges GROUP BY ALL),
p AS (SELECT CAST(s_suppkey AS BIGINT) AS site_id, s_suppkey % 20 + 0.25::DOUBLE AS x, s_suppkey * 7 % 18 + 0.75::DOUBLE AS y FROM supplier),
h AS (SELECT p.site_id, e.poly_id, any_value(b.area) AS area FROM p JOIN edges e ON TRUE JOIN b ON b.poly_id = e.poly_id GROUP BY p.site_id, e.poly_id, p.x, p.y
  HAVING sum(CASE WHEN (e.y1 > p.y) <> (e.y2 > p.y) AND p.x < e.x1 + (p.y - e.y1) * (e.x2 - e.x1) / nullif(e.y2 - e.y1, 0) THEN 1 ELSE 0 END) % 2 = 1)
SELECT site_id, poly_id FROM h QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY area, poly_id) = 1""",
)
def polygon_of_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest polygon of the whole file that holds each site's point; polygons carry no site."""
    key = F.col("s_suppkey")
    points = bridge.table(spark, sf_dir, "supplier").select(key.cast("long").alias("site_id"), (key % 20 + 0.25).cast("double").alias("x"), (key * 7 % 18 + 0.75).cast("double").alias("y"))
    return boundaries.selected(points, boundaries.of_points(points, bridge.edges(spark, sf_dir).drop("site_id")))


@query(
    "box_edges",
    f"""WITH {SITES}, b AS (SELECT site_id, lon - 0.5 AS a, lat - 0.25 AS b, lon + 0.5 AS c, lat + 0.25 AS d FROM sites)
SELECT site_id, round(x1, 9) AS x1, round(y1, 9) AS y1, round(x2, 9) AS x2, round(y2, 9) AS y2 FROM (SELECT site_id, a AS x1, b AS y1, c AS x2, b AS y2 FROM b UNION ALL SELECT site_id, c, b, c, d FROM b UNION ALL SELECT site_id, c, d, a, d FROM b UNION ALL SELECT site_id, a, d, a, b FROM b)""",
)
def box_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as polygons."""
    lon, lat = F.col("lon"), F.col("lat")
    box = F.struct((lon - F.lit(0.5)).alias("xmin"), (lat - F.lit(0.25)).alias("ymin"), (lon + F.lit(0.5)).alias("xmax"), (lat + F.lit(0.25)).alias("ymax"))
    return rounded(boundaries.box_edges(bridge.sites(spark, sf_dir).select("site_id", box.alias("box"))), "x1", "y1", "x2", "y2")


# -- fills without order ---------------------------------------------------------------------------

_MU = """b3 AS (SELECT f.* FROM feat f WHERE abs(r - 12) <= 1 AND abs(c - 12) <= 1), l3 AS (SELECT site_id, r, c, 1 AS w, w1 AS v FROM b3 UNION ALL SELECT site_id, r, c, 2, w2 FROM b3 UNION ALL SELECT site_id, r, c, 3, w3 FROM b3),
z3 AS (SELECT site_id, w, v AS s FROM l3 WHERE r = 12 AND c = 12), g3 AS (SELECT l3.site_id, l3.w, any_value(s) AS s, count(v) FILTER (abs(v - s) < 0.35 AND v BETWEEN 0.2 AND 1.5) AS n, median(v) FILTER (abs(v - s) < 0.35 AND v BETWEEN 0.2 AND 1.5) AS m FROM l3 JOIN z3 USING (site_id, w) GROUP BY ALL),
mu AS (SELECT site_id, w, CASE WHEN s IS NOT NULL THEN CASE WHEN n >= 2 THEN m ELSE s END END AS mu FROM g3),
lw AS (SELECT site_id, r, c, 1 AS w, w1 AS v FROM feat UNION ALL SELECT site_id, r, c, 2, w2 FROM feat UNION ALL SELECT site_id, r, c, 3, w3 FROM feat)"""
_FREE = {"area_threshold": (0.2, 1.5), "area_sensitivity": 0.35, "interior_threshold": (0.1, 1.5), "local_alive_density": 0.0}


def _reach(cells: str) -> str:
    """Cells that eight neighbours connect with the seed within (site_id, k); k keeps floods apart."""
    return f"rf AS (SELECT site_id, k, r, c FROM {cells} WHERE r = 12 AND c = 12 UNION SELECT o.site_id, o.k, o.r, o.c FROM rf JOIN {cells} o ON o.site_id = rf.site_id AND o.k = rf.k AND abs(o.r - rf.r) <= 1 AND abs(o.c - rf.c) <= 1)"


_OPEN_EACH = f"ow AS (SELECT lw.site_id, lw.w AS k, r, c FROM lw JOIN mu USING (site_id, w) WHERE v BETWEEN 0.2 AND 1.5 AND abs(v - mu) < 0.35), {_reach('ow')}, fm AS (SELECT DISTINCT site_id, r, c FROM rf)"


def _filled(spark: SparkSession, sf_dir: str, stages: tuple[str, ...], **more: object) -> DataFrame:
    return delineate.delineated(features(spark, sf_dir), seeds(spark), SIZE, SIZE, params(**_FREE | more), stages)


@query("fill_windows", f"WITH RECURSIVE {FX}, {_MU}, {_OPEN_EACH} SELECT site_id, r, c FROM fm")
def fill_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fill for each window by its own signature, and their union; without a density the order doesn't matter."""
    return _filled(spark, sf_dir, ("area",)).select("site_id", "r", "c")


@query(
    "fill_joint",
    f"""WITH RECURSIVE {FX}, {_MU}, oj AS (SELECT site_id, 0 AS k, r, c FROM lw LEFT JOIN mu USING (site_id, w) GROUP BY ALL HAVING count(*) FILTER (v BETWEEN 0.2 AND 1.5) > 0 AND count(*) FILTER (abs(v - mu) < 0.35) >= 2), {_reach('oj')} SELECT site_id, r, c FROM rf""",
)
def fill_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fill over cells that match in two windows at least."""
    return _filled(spark, sf_dir, ("area",), time_independent_windows=False, min_windows_alive=2).select("site_id", "r", "c")


_VALUE = "vl AS (SELECT site_id, r, c, median(v) AS v FROM lw WHERE v IS NOT NULL GROUP BY ALL), ce AS (SELECT site_id, median(mu) AS mu FROM mu WHERE mu IS NOT NULL GROUP BY ALL)"


def _line_sql(name: str, line: str, along: str) -> str:
    """Cells whose state a scan along one axis changes: those between both ends of the line's envelope."""
    return f"""{name}e AS (SELECT site_id, {line} AS line, greatest(min({along}) - 1, 1) AS lo, least(max({along}) + 1, {SIZE}) AS hi FROM fm GROUP BY ALL),
{name}m AS (SELECT fm.site_id, fm.{line} AS line, median(vl.v) AS med FROM fm JOIN vl USING (site_id, r, c) GROUP BY ALL),
{name} AS (SELECT vl.site_id, vl.r, vl.c FROM {name}e e JOIN {name}m m USING (site_id, line) JOIN ce USING (site_id) JOIN vl ON vl.site_id = e.site_id AND vl.{line} = e.line AND vl.{along} > e.lo AND vl.{along} < e.hi
  LEFT JOIN fm ON fm.site_id = vl.site_id AND fm.r = vl.r AND fm.c = vl.c WHERE e.hi - e.lo >= 2
  AND (fm.site_id IS NOT NULL) <> (CASE WHEN abs(med - mu) > 0.1 THEN abs(vl.v - mu) <= 0.1 AND vl.v BETWEEN 0.1 AND 1.5 ELSE fm.site_id IS NOT NULL AND vl.v BETWEEN 0.1 AND 1.5 END))"""


@query(
    "interior_cells",
    f"""WITH RECURSIVE {FX}, {_MU}, {_OPEN_EACH}, {_VALUE}, {_line_sql("ir", "r", "c")}, {_line_sql("ic", "c", "r")}, fl AS (SELECT * FROM ir UNION SELECT * FROM ic)
SELECT site_id, r, c FROM (SELECT * FROM fm EXCEPT SELECT * FROM fl) UNION ALL (SELECT * FROM fl EXCEPT SELECT * FROM fm)""",
)
def interior_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fill after the scan of its interior along rows and columns."""
    return _filled(spark, sf_dir, ("area", "interior"), multiple_areas=True).select("site_id", "r", "c")


@query(
    "nearest_area",
    f"""WITH RECURSIVE {FX}, {ALIVE}, {_labels_sql(_NEAR8)}, s AS (SELECT site_id, label, count(*) AS size, min(greatest(abs(r - 12), abs(c - 12))) AS dist FROM lb GROUP BY ALL),
k AS (SELECT site_id, label, row_number() OVER (PARTITION BY site_id ORDER BY dist, size DESC, label) AS k FROM s) SELECT lb.site_id, r, c, CAST(k AS INT) AS area_num FROM lb JOIN k USING (site_id, label) WHERE k <= 2""",
)
def nearest_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two areas nearest the seed (a top-k report)."""
    from ..operators import grid

    cells = delineate.labelled(alive(spark, sf_dir), seeds(spark), SIZE, SIZE)
    top = grid.ranked(cells, seeds(spark)).where("area_num <= 2").select("site_id", "label", "area_num")
    return cells.join(top, ["site_id", "label"]).select("site_id", "r", "c", "area_num")


# -- sets, totals, SQL, batch, streams ------------------------------------------------------------


@query(
    "series_rollup",
    f"WITH {VX}, s AS (SELECT site_id, scene_date, avg(v) AS v FROM vx GROUP BY ALL) SELECT coalesce(site_id, -1) AS site_id, CAST(coalesce(year(scene_date), -1) AS INT) AS year, CAST(coalesce(month(scene_date), -1) AS INT) AS month, round(avg(v), 9) AS value, count(*) AS n FROM s WHERE v IS NOT NULL GROUP BY ROLLUP (site_id, year(scene_date), month(scene_date))",
)
def series_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene means by month, year, site and in all."""
    return rounded(series.rolled_up(values(spark, sf_dir), "v").na.fill(-1, ["site_id", "year", "month"]), "value")


@query("mask_intersect", f"WITH {FX}, {EDGES}, {RASTER}, {ALIVE} SELECT site_id, r, c FROM al INTERSECT SELECT site_id, r, c FROM rst")
def mask_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alive(spark, sf_dir).intersect(boundaries.rasterised(bridge.edges(spark, sf_dir), SIZE).select("site_id", "r", "c"))


@query("mask_except", f"WITH {FX}, {EDGES}, {RASTER}, {ALIVE} SELECT site_id, r, c FROM al EXCEPT SELECT site_id, r, c FROM rst")
def mask_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alive(spark, sf_dir).subtract(boundaries.rasterised(bridge.edges(spark, sf_dir), SIZE).select("site_id", "r", "c"))


@query(
    "sql_surface",
    f"""WITH {PX}, w AS (SELECT CAST(k AS INT) AS w, CAST(ceil(2556.0 * (k - 1) / {WINDOWS}) AS INT) AS a, CASE WHEN k = {WINDOWS} THEN 2556 ELSE CAST(ceil(2556.0 * k / {WINDOWS}) AS INT) - 1 END AS b FROM range(1, {WINDOWS + 1}) t(k))
SELECT site_id, w, round(max(CAST({EVI2} AS DOUBLE)), 9) AS v FROM px JOIN w ON datediff('day', DATE '1995-01-01', scene_date) BETWEEN a AND b GROUP BY ALL""",
)
def sql_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest index of each site and window, asked in SQL with the engine's functions."""
    sql.register(spark, {"fl_scenes": bridge.pixels(spark, sf_dir)}, ["EVI2"])
    out = spark.sql("SELECT site_id, w, max(fl_evi2(red, nir)) AS v FROM fl_scenes JOIN fl_windows(DATE '1995-01-01', DATE '2001-12-31', 3) ON scene_date BETWEEN opens AND closes GROUP BY site_id, w")
    return rounded(out, "v")


_VISIT_KEY = "CAST(id AS BIGINT)"


def _attempted(pending: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """A stand-in for retrieval: some sites fail for good, some once, some always; the others have a row a day, some none."""
    key = F.col("id").cast("long")
    reason = F.when(key % 11 == 0, "no scenes at store://x/y?sig=abc").when((key % 7 == 0) & F.lit(turn < 2), "HTTP 503").when(key % 13 == 0, "timed out")
    errors = pending.withColumn("reason", reason).where("reason is not null").select("id", "reason", (key % 11 != 0).alias("retryable"))
    fine = pending.withColumn("reason", reason).where("reason is null and cast(id as long) % 5 <> 0")
    days = F.explode(F.sequence(F.col("start_date").cast("date"), F.col("end_date").cast("date")))
    return fine.select("id", days.alias("date"), (key % 100).cast("double").alias("value")), errors


@query(
    "batch_rounds",
    f"""WITH {VISITS}, c AS (SELECT *, {_VISIT_KEY} AS k, longitude NOT BETWEEN -180 AND 180 OR latitude NOT BETWEEN -90 AND 90 OR datediff('day', CAST(start_date AS DATE), CAST(end_date AS DATE)) < 2 AS bad FROM visits),
o AS (SELECT *, CASE WHEN bad THEN 'failure' WHEN k % 11 = 0 THEN 'failure' WHEN k % 13 = 0 THEN 'failure' WHEN k % 5 = 0 THEN 'empty' ELSE 'success' END AS status, CASE WHEN bad THEN 0 WHEN k % 11 = 0 THEN 1 WHEN k % 13 = 0 THEN 3 WHEN k % 7 = 0 THEN 2 ELSE 1 END AS attempts FROM c)
SELECT id, 'EVI2' AS "index", status, CASE WHEN status = 'success' THEN datediff('day', CAST(start_date AS DATE), CAST(end_date AS DATE)) + 1 ELSE 0 END AS dates, attempts, FALSE AS cached FROM o""",
)
def batch_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of all visits after three rounds."""
    return batch.rounds(visits(spark, sf_dir), "EVI2", _attempted, shared_folder(spark, "batch"), sleep=lambda s: None)[2]


@query(
    "stream_series",
    """WITH w AS (SELECT user_id % 10 AS site_id, CAST(ts AS DATE) AS d, value FROM events), m AS (SELECT max(ts) - INTERVAL 3 DAY AS mark FROM events)
SELECT site_id, CAST(d AS VARCHAR) AS day, round(avg(value), 6) AS value, count(*) AS n FROM w, m WHERE CAST(d + 1 AS TIMESTAMP) <= mark GROUP BY site_id, d""",
)
def stream_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of events up to its end: the windows that the watermark has closed."""
    base = shared_folder(spark, "stream")
    schema = bridge.table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    closed = streaming_series(events.select((F.col("user_id") % 10).alias("site_id"), F.col("ts").cast("timestamp").alias("instant"), "value"), "value")
    running = closed.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    out = spark.read.schema(closed.schema).parquet(f"{base}/rows")
    return rounded(out.select("site_id", F.to_date("start").cast("string").alias("day"), "value", "n"), "value", digits=6)


@query("fused_dates_union", f"WITH {PX} SELECT site_id, CAST(scene_date AS VARCHAR) AS day FROM px WHERE day(scene_date) % 7 = 0 UNION SELECT site_id, CAST(scene_date AS VARCHAR) FROM px WHERE qa = 1")
def fused_dates_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = bridge.pixels(spark, sf_dir).select("site_id", F.col("scene_date").cast("string").alias("day"), (F.dayofmonth("scene_date") % 7 == 0).alias("fine"), "qa")
    return own.where("fine").select("site_id", "day").unionByName(own.where("qa = 1").select("site_id", "day")).distinct()

