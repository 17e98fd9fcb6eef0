"""Queries over the bridge tables, and the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, indices, reflectance
from ..operators import boundaries, catalogue, delineate, fusion, grid, raster, series, signature
from . import batch, bridge
from .params import params

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

START, END, WINDOWS, SIZE = "1995-01-01", "2001-12-31", 3, bridge.SIZE
PX = f"px AS ({bridge.PIXELS_SQL})"
EVI2 = indices.index_sql("EVI2", "duckdb")
VX = f"{PX}, vx AS (SELECT *, CAST({EVI2} AS DOUBLE) AS v FROM px)"
DAYS = 2556


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def values(spark: SparkSession, sf_dir: str, name: str = "EVI2", out: str = "v") -> DataFrame:
    return indices.with_index(bridge.pixels(spark, sf_dir), name, out)


# -- indices ---------------------------------------------------------------------------------------


def _index_query(sensor: str) -> None:
    names = indices.supported(sensor)
    # only library functions differ in their last bits; the rest is the same arithmetic on both engines
    loose = ("kNDVI", "MSAVI", "BAI")
    text = ", ".join(f"round(CAST({indices.index_sql(n, 'duckdb')} AS DOUBLE), 9) + 0.0::DOUBLE AS {n.lower()}" if n in loose else f"CAST({indices.index_sql(n, 'duckdb')} AS DOUBLE) + 0.0::DOUBLE AS {n.lower()}" for n in names)

    @query(f"idx_{sensor.replace('-', '_')}", f"WITH {PX} SELECT site_id, CAST(scene_date AS VARCHAR) AS day, r, c, tile, {text} FROM px")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        px = bridge.pixels(spark, sf_dir)
        return px.select("site_id", F.col("scene_date").cast("string").alias("day"), "r", "c", "tile", *((F.round(indices.index(n), 9) if n in loose else indices.index(n) + F.lit(0.0)).alias(n.lower()) for n in names))


for _sensor in ("sentinel-2", "landsat-8", "mcd43a4"):
    _index_query(_sensor)


# -- reflectance and masks -------------------------------------------------------------------------


@query(
    "reflectance_scale",
    f"""WITH {PX}, d AS (SELECT site_id, tile, qa, CAST(floor(nir * 10000) AS BIGINT) + CASE WHEN tile % 2 = 1 THEN 1000 ELSE 0 END AS dn, CASE WHEN tile % 2 = 1 THEN 1000 ELSE 0 END AS off FROM px)
SELECT site_id, tile, qa, dn, round(CASE WHEN dn - off BETWEEN 1 AND 10000 THEN (dn - off) * 0.0001::DOUBLE + 0.0::DOUBLE END, 9) AS s2,
  round(CASE WHEN dn * 8 BETWEEN 7273 AND 43636 THEN dn * 8 * 0.0000275::DOUBLE + (-0.2)::DOUBLE END, 9) AS landsat FROM d""",
)
def reflectance_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = bridge.pixels(spark, sf_dir)
    off = reflectance.baseline_offset(F.when(F.col("tile") % 2 == 1, "05.10").otherwise("02.04")).cast("bigint")
    d = px.select("site_id", "tile", "qa", (F.floor(F.col("nir") * 10000) + off).alias("dn"), off.alias("off"))
    s2, landsat = reflectance.reflectance(F.col("dn"), "sentinel-2", F.col("off")), reflectance.reflectance(F.col("dn") * 8, "landsat-8")
    return d.select("site_id", "tile", "qa", "dn", F.round(s2, 9).alias("s2"), F.round(landsat, 9).alias("landsat"))


@query("mask_class", f"WITH {PX} SELECT site_id, qa, count(*) AS n FROM px WHERE qa NOT IN (3, 8) GROUP BY ALL")
def mask_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.pixels(spark, sf_dir).where(reflectance.clear_of_classes(F.col("qa"), [3, 8])).groupBy("site_id", "qa").agg(F.count(F.lit(1)).alias("n"))


@query("mask_bits", f"WITH {PX} SELECT site_id, qa, count(*) AS n FROM px WHERE qa & 5 = 0 GROUP BY ALL")
def mask_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.pixels(spark, sf_dir).where(reflectance.clear_of_bits(F.col("qa"), [0, 2])).groupBy("site_id", "qa").agg(F.count(F.lit(1)).alias("n"))


# -- catalogue -------------------------------------------------------------------------------------

CAT = f"cat AS ({bridge.CATALOGUE_SQL})"
_SOURCE = "CASE WHEN scene_date + INTERVAL 18 YEAR >= DATE '2015-07-01' THEN 'sentinel-2' WHEN scene_date + INTERVAL 18 YEAR >= DATE '2013-04-01' THEN 'landsat-8' ELSE 'landsat-5' END"


@query("resolve_source", f"WITH {CAT} SELECT {_SOURCE} AS source, count(*) AS n FROM cat GROUP BY 1")
def resolve_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.add_months("scene_date", 18 * 12)
    return bridge.catalogue(spark, sf_dir).groupBy(catalogue.resolved_source(day).alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query("catalogue_filter", f"WITH {CAT} SELECT item_id, CAST(scene_date AS VARCHAR) AS day, cloud, platform FROM cat WHERE scene_date BETWEEN DATE '1996-01-01' AND DATE '1998-06-30' AND cloud <= 50 AND platform IN ('landsat-8', 'landsat-9')")
def catalogue_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = catalogue.items(bridge.catalogue(spark, sf_dir), "1996-01-01", "1998-06-30", 50, reflectance.sensor("landsat-8").platforms)
    return own.select("item_id", F.col("scene_date").cast("string").alias("day"), "cloud", "platform")


def _processing(order: str, way: str) -> None:
    @query(
        f"processing_{order.split('_')[0]}",
        f"""WITH {CAT}, k AS (SELECT *, CASE WHEN tile % 13 = 0 THEN NULL ELSE tile // 3 END AS t FROM cat),
o AS (SELECT *, max(CASE WHEN major IS NULL OR minor IS NULL THEN 1 ELSE 0 END) OVER w AS open,
  row_number() OVER (PARTITION BY platform, t, scene_date, CASE WHEN t IS NULL THEN item_id END ORDER BY major {way} NULLS LAST, minor {way} NULLS LAST, generation IS NULL, generation {way} NULLS LAST, item_id) AS k FROM k
  WINDOW w AS (PARTITION BY platform, t, scene_date, CASE WHEN t IS NULL THEN item_id END))
SELECT item_id, coalesce(major, -1) AS major, minor, generation FROM o WHERE k = 1 OR open = 1""",
    )
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        items = bridge.catalogue(spark, sf_dir).withColumn("t", F.when(F.col("tile") % 13 != 0, F.floor(F.col("tile") / 3)))
        return catalogue.select_processing(items, ["platform", "t", "scene_date"], order).select("item_id", F.coalesce("major", F.lit(-1)).alias("major"), "minor", "generation")


_processing("highest_baseline", "DESC")
_processing("lowest_baseline", "ASC")


# -- mosaics, composites, features -----------------------------------------------------------------


@query(
    "mosaic_by_date",
    f"""WITH {PX}, m AS (SELECT site_id, scene_date, r, c, tile * 10 + qa AS o, CASE WHEN qa = 2 THEN NULL ELSE nir END AS nir, CASE WHEN qa = 3 THEN NULL ELSE red END AS red FROM px)
SELECT site_id, CAST(scene_date AS VARCHAR) AS day, r, c, arg_min(nir, o) FILTER (nir IS NOT NULL) AS nir, arg_min(red, o) FILTER (red IS NOT NULL) AS red FROM m GROUP BY ALL""",
)
def mosaic_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = bridge.pixels(spark, sf_dir).select("site_id", "scene_date", "r", "c", (F.col("tile") * 10 + F.col("qa")).alias("o"), F.when(F.col("qa") != 2, F.col("nir")).alias("nir"), F.when(F.col("qa") != 3, F.col("red")).alias("red"))
    out = raster.mosaic(px, ["site_id", "scene_date", "r", "c"], ["nir", "red"], "o")
    return out.withColumn("scene_date", F.col("scene_date").cast("string")).withColumnRenamed("scene_date", "day")


@query(
    "harmonise_coarse",
    f"""WITH {PX}, k AS (SELECT site_id, r, c, max(nir) AS v FROM px WHERE qa < 3 GROUP BY ALL),
f AS (SELECT site_id, fr.r, fc.c FROM (SELECT DISTINCT site_id FROM k), range(-1, {2 * SIZE + 3}) fr(r), range(-1, {2 * SIZE + 3}) fc(c)),
w AS (SELECT f.site_id, f.r, f.c, k.v, greatest(0.0::DOUBLE, 1.0::DOUBLE - abs(f.r - ((k.r - 0.5::DOUBLE) * 2 + 0.5::DOUBLE)) / 2) * greatest(0.0::DOUBLE, 1.0::DOUBLE - abs(f.c - ((k.c - 0.5::DOUBLE) * 2 + 0.5::DOUBLE)) / 2) AS w
  FROM f JOIN k ON k.site_id = f.site_id AND abs(f.r - 2 * k.r) <= 3 AND abs(f.c - 2 * k.c) <= 3)
SELECT site_id, CAST(r AS INT) AS r, CAST(c AS INT) AS c, round(sum(v * w) / sum(w), 9) AS v FROM w WHERE w > 0 GROUP BY ALL""",
)
def harmonise_coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    coarse = bridge.pixels(spark, sf_dir).where("qa < 3").groupBy("site_id", "r", "c").agg(F.max("nir").alias("v"))
    return rounded(raster.refined(coarse, "v", 2, ["site_id"]), "v")


def _composite(how: str) -> None:
    duck = {"median": "median", "mean": "avg"}.get(how, how)
    digits = 6 if how == "sum" else 9

    @query(f"composite_{how}", f"WITH {VX} SELECT site_id, r, c, round({duck}(v), {digits}) AS v FROM vx GROUP BY ALL")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(raster.composite(values(spark, sf_dir), "v", how), "v", digits=digits)


for _how in raster.REDUCERS:
    _composite(_how)


@query("composite_all_missing", f"WITH {VX} SELECT site_id, r, c, round(sum(CASE WHEN r > 12 THEN v END), 6) AS v FROM vx GROUP BY ALL")
def composite_all_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = values(spark, sf_dir).withColumn("v", F.when(F.col("r") > 12, F.col("v")))
    return rounded(raster.composite(own, "v", "sum"), "v", digits=6)


MASK = f"mask AS (SELECT DISTINCT site_id, r, c, CASE WHEN c <= 8 THEN 1 ELSE 2 END AS area_num FROM px WHERE r BETWEEN 4 AND 15 AND (c BETWEEN 3 AND 8 OR c BETWEEN 12 AND 18))"


def mask_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = bridge.pixels(spark, sf_dir).where("r BETWEEN 4 AND 15 AND (c BETWEEN 3 AND 8 OR c BETWEEN 12 AND 18)")
    return px.select("site_id", "r", "c", F.when(F.col("c") <= 8, 1).otherwise(2).alias("area_num")).distinct()


@query(
    "composite_masked",
    f"""WITH {VX}, {MASK}, m AS (SELECT site_id, r, c, median(v) AS v FROM vx GROUP BY ALL)
SELECT m.site_id, m.r, m.c, round(CASE WHEN area_num = 1 THEN v END, 9) AS area_1, round(CASE WHEN area_num = 2 THEN v END, 9) AS area_2, round(CASE WHEN area_num IS NOT NULL THEN v END, 9) AS "union"
FROM m LEFT JOIN mask USING (site_id, r, c)""",
)
def composite_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = raster.area_layers(raster.composite(values(spark, sf_dir), "v"), mask_cells(spark, sf_dir), "v", ["site_id", "r", "c"], [1, 2])
    return rounded(out, "area_1", "area_2", "union")


_W = f"CAST(least({WINDOWS}, (datediff('day', DATE '{START}', scene_date) * {WINDOWS}) // {DAYS} + 1) AS INT)"
FEATURES = f"""feat AS (SELECT site_id, r, c, max(v) FILTER (w = 1) AS w1, max(v) FILTER (w = 2) AS w2, max(v) FILTER (w = 3) AS w3
  FROM (SELECT *, {_W} AS w FROM vx WHERE scene_date BETWEEN DATE '{START}' AND DATE '{END}') GROUP BY ALL)"""
FX = f"{VX}, {FEATURES}"
LONG = "lx AS (SELECT site_id, r, c, 1 AS w, w1 AS v FROM feat UNION ALL SELECT site_id, r, c, 2, w2 FROM feat UNION ALL SELECT site_id, r, c, 3, w3 FROM feat)"


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.window_features(values(spark, sf_dir), "v", START, END, WINDOWS)


@query("window_features", f"WITH {FX} SELECT site_id, r, c, round(w1, 9) AS w1, round(w2, 9) AS w2, round(w3, 9) AS w3 FROM feat")
def window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features(spark, sf_dir), "w1", "w2", "w3")


@query(
    "empty_windows",
    f"""WITH {VX}, s AS (SELECT *, CAST(least(40, (datediff('day', DATE '{START}', scene_date) * 40) // {DAYS} + 1) AS INT) AS w FROM vx WHERE scene_date BETWEEN DATE '{START}' AND DATE '{END}')
SELECT i.site_id, i.r, i.c, CAST(n.w AS INT) AS w FROM (SELECT DISTINCT site_id, r, c FROM vx) i, range(1, 41) n(w) WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.site_id = i.site_id AND s.r = i.r AND s.c = i.c AND s.w = n.w AND s.v IS NOT NULL)""",
)
def empty_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell of every site."""
    return raster.empty_windows(values(spark, sf_dir), "v", START, END, 40, ("site_id", "r", "c"))


# -- series ----------------------------------------------------------------------------------------

_BUCKET = {"daily": "%Y-%m-%d", "monthly": "%Y-%m", "yearly": "%Y"}


def _series(every: str) -> None:
    @query(f"series_{every}", f"WITH {VX}, s AS (SELECT site_id, scene_date, avg(v) AS v FROM vx GROUP BY ALL) SELECT site_id, strftime(scene_date, '{_BUCKET[every]}') AS date, round(avg(v), 9) AS value FROM s WHERE v IS NOT NULL GROUP BY ALL")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(series.series(values(spark, sf_dir), "v", every), "value")


for _every in _BUCKET:
    _series(_every)


@query(
    "series_multi_area",
    f"""WITH {VX}, {MASK}, s AS (SELECT site_id, scene_date, median(v) FILTER (area_num = 1) AS a, median(v) FILTER (area_num = 2) AS b, median(v) AS u FROM vx JOIN mask USING (site_id, r, c) GROUP BY ALL)
SELECT site_id, strftime(scene_date, '%Y-%m') AS date, round(median(a), 9) AS area_1, round(median(b), 9) AS area_2, round(median(u), 9) AS "union" FROM s GROUP BY ALL""",
)
def series_multi_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series.area_series(values(spark, sf_dir), mask_cells(spark, sf_dir), "v", [1, 2], "monthly", "median")
    return rounded(out, "area_1", "area_2", "union")


@query(
    "series_observed_first",
    """WITH e AS (SELECT CAST(user_id % 10 AS INT) AS site_id, CAST(ts AS DATE) AS d, event_type <> 'click' AS is_fused, avg(value) AS value FROM events GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY site_id, d ORDER BY is_fused) AS k FROM e)
SELECT site_id, CAST(d AS VARCHAR) AS day, is_fused, round(value, 9) AS value FROM k WHERE k = 1""",
)
def series_observed_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bridge.table(spark, sf_dir, "events").select((F.col("user_id") % 10).cast("int").alias("site_id"), F.col("ts").cast("date").alias("scene_date"), (F.col("event_type") != "click").alias("is_fused"), "value")
    out = series.observed_first(e.groupBy("site_id", "scene_date", "is_fused").agg(F.avg("value").alias("value")))
    return rounded(out.select("site_id", F.col("scene_date").cast("string").alias("day"), "is_fused", "value"), "value")


@query("series_custom_agg", f"WITH {VX}, s AS (SELECT site_id, scene_date, max(v) - min(v) AS v FROM vx WHERE v IS NOT NULL GROUP BY ALL) SELECT site_id, strftime(scene_date, '%Y') AS date, round(max(v) - min(v), 9) AS value FROM s GROUP BY ALL")
def series_custom_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.custom_series(values(spark, sf_dir), "v", lambda x: x.max() - x.min(), "yearly"), "value")


# -- signatures and calibration --------------------------------------------------------------------

SIG = """sm AS (SELECT site_id, w, count(v) AS n, median(v) AS mu FROM lx WHERE v IS NOT NULL GROUP BY ALL),
sg AS (SELECT l.site_id, l.w, any_value(s.n) AS n, any_value(s.mu) AS mu, 1.4826::DOUBLE * median(abs(l.v - s.mu)) AS disp FROM lx l JOIN sm s USING (site_id, w) WHERE l.v IS NOT NULL GROUP BY ALL)"""
FLOOR = signature.noise_floor("EVI2")
SEEDS = "seeds AS (SELECT CAST(i AS INT) AS site_id, 12 AS r0, 12 AS c0, 11 AS rmax FROM range(5) t(i))"


def long_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature.long_windows(features(spark, sf_dir))


def seeds(spark: SparkSession) -> DataFrame:
    return spark.range(5).select(F.col("id").cast("int").alias("site_id"), F.lit(12).alias("r0"), F.lit(12).alias("c0"), F.lit(11).alias("rmax"))


@query("signature_mad", f"WITH {FX}, {LONG}, {SIG} SELECT site_id, w, n, round(CASE WHEN n >= 2 THEN mu END, 9) AS mu, round(CASE WHEN n >= 2 THEN disp END, 9) AS disp FROM sg")
def signature_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signature.signature(long_values(spark, sf_dir)), "mu", "disp")


@query(
    "learn_signature",
    f"""WITH {FX}, {SEEDS}, b AS (SELECT f.* FROM feat f JOIN seeds s USING (site_id) WHERE abs(r - r0) <= 1 AND abs(c - c0) <= 1),
l AS (SELECT site_id, r, c, 1 AS w, w1 AS v FROM b UNION ALL SELECT site_id, r, c, 2, w2 FROM b UNION ALL SELECT site_id, r, c, 3, w3 FROM b),
z AS (SELECT site_id, w, v AS s FROM l WHERE r = 12 AND c = 12),
g AS (SELECT l.site_id, l.w, any_value(s) AS s, count(v) FILTER (abs(v - s) < 0.2 AND v BETWEEN 0.2 AND 0.9) AS n, median(v) FILTER (abs(v - s) < 0.2 AND v BETWEEN 0.2 AND 0.9) AS m FROM l LEFT JOIN z USING (site_id, w) GROUP BY ALL)
SELECT site_id, w, round(CASE WHEN s IS NULL THEN NULL WHEN n >= 2 THEN m ELSE s END, 9) AS mu FROM g""",
)
def learn_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signature.learned(features(spark, sf_dir), seeds(spark), 0.2, 0.2, 0.9), "mu")


GAP = f"""gr AS (SELECT site_id, w, v, row_number() OVER (PARTITION BY site_id, w ORDER BY v) AS i, count(*) OVER (PARTITION BY site_id, w) AS n FROM lx WHERE v IS NOT NULL),
gk AS (SELECT *, v - lag(v) OVER (PARTITION BY site_id, w ORDER BY v) AS gap FROM gr WHERE i > greatest(1, floor(n * 0.05)) AND i <= n - greatest(1, floor(n * 0.05))),
gs AS (SELECT k.site_id, k.w, CASE WHEN max(k.n) >= 8 THEN max(gap) / greatest(any_value(sg.disp), {FLOOR!r}::DOUBLE) END AS sep FROM gk k JOIN sg USING (site_id, w) GROUP BY ALL)"""


@query("mode_gap", f"WITH {FX}, {LONG}, {SIG}, {GAP} SELECT site_id, w, round(sep, 9) AS sep FROM gs")
def mode_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signature.mode_gap(long_values(spark, sf_dir), FLOOR), "sep")


@query(
    "calibrate_scene",
    f"""WITH {FX}, {LONG}, {SIG}, {GAP}, t AS (SELECT site_id, w, n, mu, disp, greatest(2.2::DOUBLE * disp, {FLOOR!r}::DOUBLE) AS tol, sep,
  CASE WHEN n < 5 THEN 'n_below_min' WHEN disp IS NULL THEN 'disp_na' WHEN disp >= (0.7::DOUBLE - 0.2::DOUBLE) / (2 * 2.2::DOUBLE) THEN 'disp_crossover' END AS reason FROM sg LEFT JOIN gs USING (site_id, w))
SELECT site_id, w, round(tol, 9) AS tol, reason, coalesce(sep >= 3.0, FALSE) AS multimodal, reason IS NULL AND NOT coalesce(sep >= 3.0, FALSE) AS valid FROM t""",
)
def calibrate_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = signature.calibrated(long_values(spark, sf_dir), "EVI2")
    return rounded(out.select("site_id", "w", "tol", "reason", "multimodal", "valid"), "tol")


@query(
    "support_radius",
    f"""WITH {FX}, {LONG}, {SEEDS}, x AS (SELECT l.*, greatest(abs(r - r0), abs(c - c0)) AS ring FROM lx l JOIN seeds USING (site_id) WHERE v IS NOT NULL),
a AS (SELECT x.site_id, x.w, x.v, CAST(q.radius AS INT) AS radius FROM x, range(2, 12) q(radius) WHERE ring <= q.radius),
m AS (SELECT site_id, w, radius, count(*) AS n, median(v) AS mu FROM a GROUP BY ALL),
d AS (SELECT a.site_id, a.w, a.radius, any_value(m.n) AS n, 1.4826::DOUBLE * median(abs(a.v - m.mu)) AS disp FROM a JOIN m USING (site_id, w, radius) GROUP BY ALL),
e AS (SELECT site_id, radius, max(1.166::DOUBLE * disp / sqrt(n)) AS se FROM d WHERE n >= 2 GROUP BY ALL)
SELECT s.site_id, CAST(coalesce((SELECT min(radius) FROM e WHERE e.site_id = s.site_id AND se <= 0.005::DOUBLE), rmax) AS INT) AS radius FROM seeds s""",
)
def support_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid is the only bound; the noise floor is so low that sites reach it."""
    return signature.support(features(spark, sf_dir), seeds(spark), 0.005)


# -- fusion ----------------------------------------------------------------------------------------

DATES = "fd AS (SELECT DISTINCT site_id, scene_date FROM px WHERE day(scene_date) % 7 = 0), cd AS (SELECT DISTINCT site_id, scene_date FROM px WHERE day(scene_date) % 7 <> 0)"


def dates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = bridge.pixels(spark, sf_dir).select("site_id", "scene_date").distinct()
    fine = F.dayofmonth("scene_date") % 7 == 0
    return own.where(fine), own.where(~fine)


@query("uncovered_dates", f"WITH {PX}, {DATES} SELECT site_id, CAST(scene_date AS VARCHAR) AS day FROM cd WHERE NOT EXISTS (SELECT 1 FROM fd WHERE fd.site_id = cd.site_id AND abs(datediff('day', fd.scene_date, cd.scene_date)) <= 3)")
def uncovered_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine, coarse = dates(spark, sf_dir)
    return fusion.uncovered(coarse, fine).select("site_id", F.col("scene_date").cast("string").alias("day"))


_NEAR = "arg_min({b}.scene_date, abs(datediff('day', {a}.scene_date, {b}.scene_date)) * 100000 + datediff('day', DATE '1990-01-01', {b}.scene_date))"


@query(
    "anchor_nearest",
    f"""WITH {PX}, {DATES}, u AS (SELECT * FROM cd WHERE NOT EXISTS (SELECT 1 FROM fd WHERE fd.site_id = cd.site_id AND abs(datediff('day', fd.scene_date, cd.scene_date)) <= 3)),
a AS (SELECT u.site_id, u.scene_date, {_NEAR.format(a="u", b="fd")} AS anchor FROM u JOIN fd USING (site_id) GROUP BY ALL),
p AS (SELECT fd.site_id, fd.scene_date AS anchor, {_NEAR.format(a="fd", b="cd")} AS partner FROM fd JOIN cd USING (site_id) GROUP BY ALL)
SELECT site_id, CAST(scene_date AS VARCHAR) AS day, CAST(anchor AS VARCHAR) AS anchor, CAST(partner AS VARCHAR) AS partner, CAST(abs(datediff('day', scene_date, anchor)) AS INT) AS anchor_days
FROM a JOIN p USING (site_id, anchor) WHERE abs(datediff('day', anchor, partner)) <= 1""",
)
def anchor_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine, coarse = dates(spark, sf_dir)
    out = fusion.anchored(coarse, fine)
    return out.select("site_id", F.col("scene_date").cast("string").alias("day"), F.col("anchor").cast("string"), F.col("partner").cast("string"), "anchor_days")


_CELLS = "SELECT site_id, scene_date, CAST((r - 1) // 8 + 1 AS INT) AS r, CAST((c - 1) // 8 + 1 AS INT) AS c, median(nir) AS nir, median(red) AS red FROM px WHERE day(scene_date) % 7 {op} 0 GROUP BY ALL"
BLOCKS = f"fb AS MATERIALIZED ({_CELLS.format(op='=')}), cb AS MATERIALIZED ({_CELLS.format(op='<>')})"


def blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Fine and coarse scenes on a grid of 3 x 3 blocks, dense enough to meet."""
    small = lambda x: (F.floor((F.col(x) - 1) / 8) + 1).cast("int").alias(x)
    own = bridge.pixels(spark, sf_dir).groupBy("site_id", "scene_date", small("r"), small("c")).agg(F.median("nir").alias("nir"), F.median("red").alias("red"))
    fine = F.dayofmonth("scene_date") % 7 == 0
    return own.where(fine), own.where(~fine)


def _delta_sql(b: str) -> str:
    top = f"CASE WHEN m_{b} >= 1e-6 THEN m_{b} ELSE 1.0::DOUBLE END"
    return f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, f_{b} + greatest(0.0::DOUBLE, 1 - abs(f_{b} - p_{b}) / ({top})) * (q_{b} - p_{b})))"


@query(
    "fuse_delta",
    f"""WITH {PX}, {DATES}, {BLOCKS}, a AS (SELECT fd.site_id, fd.scene_date AS anchor, {_NEAR.format(a="fd", b="cd")} AS partner FROM fd JOIN cd USING (site_id) GROUP BY ALL),
pr AS MATERIALIZED (SELECT a.*, cd.scene_date FROM a JOIN cd USING (site_id) WHERE datediff('day', a.anchor, cd.scene_date) BETWEEN 1 AND 6),
j1 AS MATERIALIZED (SELECT pr.*, f.r, f.c, f.nir AS f_nir, f.red AS f_red FROM pr JOIN fb f ON f.site_id = pr.site_id AND f.scene_date = pr.anchor),
j2 AS MATERIALIZED (SELECT j1.*, p.nir AS p_nir, p.red AS p_red FROM j1 JOIN cb p ON p.site_id = j1.site_id AND p.scene_date = j1.partner AND p.r = j1.r AND p.c = j1.c),
j AS MATERIALIZED (SELECT j2.*, q.nir AS q_nir, q.red AS q_red FROM j2 JOIN cb q ON q.site_id = j2.site_id AND q.scene_date = j2.scene_date AND q.r = j2.r AND q.c = j2.c),
m AS (SELECT *, max(abs(f_nir - p_nir)) OVER w AS m_nir, max(abs(f_red - p_red)) OVER w AS m_red FROM j WINDOW w AS (PARTITION BY site_id, scene_date)),
o AS (SELECT *, {_delta_sql("nir")} AS nir, {_delta_sql("red")} AS red FROM m)
SELECT site_id, CAST(scene_date AS VARCHAR) AS day, r, c, CAST(anchor AS VARCHAR) AS anchor, round(nir, 9) AS nir, round(red, 9) AS red, round({EVI2}, 9) AS v FROM o""",
)
def fuse_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine_days, coarse_days = dates(spark, sf_dir)
    fine, coarse = blocks(spark, sf_dir)
    anchors = fusion.nearest(fine_days, coarse_days, "partner").withColumnRenamed("scene_date", "anchor")
    after = F.expr("transform(sequence(1, 6), d -> date_add(anchor, d))")
    pairs = anchors.withColumn("scene_date", F.explode(after)).join(coarse_days, ["site_id", "scene_date"], "left_semi")
    out = indices.with_index(fusion.fused(pairs, fine, coarse, ["nir", "red"]), "EVI2", "v")
    return rounded(out.select("site_id", F.col("scene_date").cast("string").alias("day"), "r", "c", F.col("anchor").cast("string"), "nir", "red", "v"), "nir", "red", "v")


_METRICS = """CASE WHEN count(*) >= 4 THEN round(sqrt(avg((pred - obs) * (pred - obs))), 9) END AS rmse, CASE WHEN count(*) >= 4 THEN round(avg(abs(pred - obs)), 9) END AS mae, CASE WHEN count(*) >= 4 THEN round(avg(pred - obs), 9) + 0.0::DOUBLE END AS bias,
  CASE WHEN count(*) >= 4 AND stddev_pop(obs) > 1e-12 AND stddev_pop(pred) > 1e-12 THEN round(covar_pop(obs, pred) / (stddev_pop(obs) * stddev_pop(pred)), 6) + 0.0::DOUBLE END AS r"""
_EVI2_OF = "(2.5 * ({n} - {d})) / nullif({n} + 2.4 * {d} + 1, 0)"
LOO = f"""ld AS (SELECT site_id, scene_date, lag(scene_date) OVER w AS b, lead(scene_date) OVER w AS a FROM fd WINDOW w AS (PARTITION BY site_id ORDER BY scene_date)),
ln AS (SELECT site_id, scene_date, CASE WHEN a IS NULL OR datediff('day', b, scene_date) <= datediff('day', scene_date, a) THEN b ELSE a END AS anchor FROM ld WHERE a IS NOT NULL OR b IS NOT NULL),
lp AS (SELECT * FROM (SELECT fd.site_id, fd.scene_date, {_NEAR.format(a="fd", b="cd")} AS partner FROM fd JOIN cd USING (site_id) GROUP BY ALL) WHERE abs(datediff('day', scene_date, partner)) <= 1),
lk AS MATERIALIZED (SELECT n.site_id, n.scene_date, n.anchor, x.partner AS now, y.partner AS thn FROM ln n JOIN lp x ON x.site_id = n.site_id AND x.scene_date = n.scene_date JOIN lp y ON y.site_id = n.site_id AND y.scene_date = n.anchor WHERE x.partner <> y.partner),
l1 AS MATERIALIZED (SELECT k.*, o.r, o.c, {_EVI2_OF.format(n="o.nir", d="o.red")} AS obs FROM lk k JOIN fb o ON o.site_id = k.site_id AND o.scene_date = k.scene_date),
l2 AS MATERIALIZED (SELECT l1.*, f.nir AS f_nir, f.red AS f_red FROM l1 JOIN fb f ON f.site_id = l1.site_id AND f.scene_date = l1.anchor AND f.r = l1.r AND f.c = l1.c),
l3 AS MATERIALIZED (SELECT l2.*, p.nir AS p_nir, p.red AS p_red FROM l2 JOIN cb p ON p.site_id = l2.site_id AND p.scene_date = l2.thn AND p.r = l2.r AND p.c = l2.c),
lj AS MATERIALIZED (SELECT l3.*, q.nir AS q_nir, q.red AS q_red FROM l3 JOIN cb q ON q.site_id = l3.site_id AND q.scene_date = l3.now AND q.r = l3.r AND q.c = l3.c),
lm AS (SELECT *, max(abs(f_nir - p_nir)) OVER w AS m_nir, max(abs(f_red - p_red)) OVER w AS m_red FROM lj WINDOW w AS (PARTITION BY site_id, scene_date)),
le AS (SELECT *, {_delta_sql("nir")} AS e_nir, {_delta_sql("red")} AS e_red FROM lm), lo AS (SELECT *, {_EVI2_OF.format(n="e_nir", d="e_red")} AS pred FROM le)"""


def left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine, coarse = blocks(spark, sf_dir)
    return fusion.leave_one_out(fine, coarse, "EVI2")


def _metrics(df: DataFrame) -> DataFrame:
    return rounded(rounded(df, "rmse", "mae", "bias"), "r", digits=6)


@query("loo_scene", f"WITH {PX}, {DATES}, {BLOCKS}, {LOO} SELECT site_id, CAST(scene_date AS VARCHAR) AS day, {_METRICS}, count(*) AS n_pixels FROM lo GROUP BY site_id, scene_date")
def loo_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _metrics(fusion.agreement(left_out(spark, sf_dir), ["site_id", "scene_date"], count="n_pixels"))
    return out.withColumn("scene_date", F.col("scene_date").cast("string")).withColumnRenamed("scene_date", "day")


@query("loo_pixel", f"""WITH {PX}, {DATES}, {BLOCKS}, {LOO} SELECT site_id, r AS "row", c AS col, {_METRICS}, count(*) AS n_scenes FROM lo GROUP BY site_id, lo.r, lo.c""")
def loo_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = left_out(spark, sf_dir).withColumnsRenamed({"r": "row", "c": "col"})
    return _metrics(fusion.agreement(own, ["site_id", "row", "col"], count="n_scenes"))


# -- geometry and boundaries -----------------------------------------------------------------------

SITES = f"sites AS ({bridge.SITES_SQL})"


@query("utm_epsg", f"WITH {SITES} SELECT site_id, coalesce({geo.utm_epsg_sql('lon', 'lat')}, -1) AS epsg FROM sites")
def utm_epsg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.sites(spark, sf_dir).select("site_id", F.coalesce(geo.utm_epsg(F.col("lon"), F.col("lat")), F.lit(-1)).alias("epsg"))


_DX, _DY = geo.metres_to_degrees_sql("lat", "1000.0::DOUBLE")


@query("metres_to_degrees", f"WITH {SITES} SELECT site_id, round({_DX}, 9) AS dx, round({_DY}, 9) AS dy FROM sites")
def metres_to_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    dx, dy = geo.metres_to_degrees(F.col("lat"), F.lit(1000.0))
    return rounded(bridge.sites(spark, sf_dir).select("site_id", dx.alias("dx"), dy.alias("dy")), "dx", "dy")


@query("point_bbox", f"WITH {SITES} SELECT site_id, round(lon - {_DX} / 2, 9) AS xmin, round(lat - {_DY} / 2, 9) AS ymin, round(lon + {_DX} / 2, 9) AS xmax, round(lat + {_DY} / 2, 9) AS ymax FROM sites WHERE lon - {_DX} / 2 >= -180 AND lon + {_DX} / 2 <= 180")
def point_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = geo.bbox(F.col("lon"), F.col("lat"), F.lit(1000.0), F.lit(1000.0))
    return rounded(bridge.sites(spark, sf_dir).select("site_id", box.alias("b")).where("b is not null").select("site_id", "b.*"), "xmin", "ymin", "xmax", "ymax")


@query("bbox_quantise", f"WITH {SITES} SELECT site_id, round(floor((lon - 0.003) / 0.01::DOUBLE) * 0.01::DOUBLE, 9) AS low, round(ceil((lon + 0.003) / 0.01::DOUBLE) * 0.01::DOUBLE, 9) AS high FROM sites")
def bbox_quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = geo.quantised(F.col("lon") - F.lit(0.003), F.col("lon") + F.lit(0.003))
    return rounded(bridge.sites(spark, sf_dir).select("site_id", low.alias("low"), high.alias("high")), "low", "high")


EDGES = f"edges AS ({bridge.EDGES_SQL})"
_INSIDE = "CASE WHEN (y1 > {y}) <> (y2 > {y}) AND {x} < x1 + ({y} - y1) * (x2 - x1) / nullif(y2 - y1, 0) THEN 1 ELSE 0 END"
RASTER = f"rst AS (SELECT site_id, poly_id, r, c FROM edges, (SELECT CAST(i AS INT) AS r FROM range(1, {SIZE + 1}) a(i)), (SELECT CAST(i AS INT) AS c FROM range(1, {SIZE + 1}) b(i)) GROUP BY ALL HAVING sum({_INSIDE.format(x='(c - 0.5)', y='(r - 0.5)')}) % 2 = 1)"


@query("rasterise_centre", f"WITH {EDGES}, {RASTER} SELECT site_id, poly_id, r, c FROM rst")
def rasterise_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundaries.rasterised(bridge.edges(spark, sf_dir), SIZE)


@query(
    "select_field",
    f"""WITH {EDGES}, h AS (SELECT site_id, poly_id, abs(sum(x1 * y2 - x2 * y1)) / 2 AS area FROM edges GROUP BY ALL HAVING sum({_INSIDE.format(x='8.25', y='7.75')}) % 2 = 1)
SELECT site_id, poly_id FROM h QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY area, poly_id) = 1""",
)
def select_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = bridge.edges(spark, sf_dir)
    points = edges.select("site_id").distinct().select("site_id", F.lit(8.25).alias("x"), F.lit(7.75).alias("y"))
    return boundaries.selected(points, edges)


@query(
    "agreement_iou",
    f"""WITH {FX}, {EDGES}, {RASTER}, p AS (SELECT site_id, r, c FROM feat WHERE w1 >= 0.7), q AS (SELECT DISTINCT site_id, r, c FROM rst),
u AS (SELECT site_id, r, c, max(p) AS p, max(q) AS q FROM (SELECT *, 1 AS p, 0 AS q FROM p UNION ALL SELECT *, 0, 1 FROM q) GROUP BY ALL),
s AS (SELECT site_id, CAST(sum(p) AS BIGINT) AS n_pred, CAST(sum(q) AS BIGINT) AS n_ref, CAST(sum(p * q) AS BIGINT) AS n_intersection, count(*) AS n_union FROM u GROUP BY ALL)
SELECT *, round(n_intersection / nullif(n_union, 0), 9) AS iou, round(2 * n_intersection / nullif(n_pred + n_ref, 0), 9) AS f1, round(n_intersection / nullif(n_pred, 0), 9) AS precision, round(n_intersection / nullif(n_ref, 0), 9) AS recall FROM s""",
)
def agreement_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicted = features(spark, sf_dir).where("w1 >= 0.7").select("site_id", "r", "c")
    reference = boundaries.rasterised(bridge.edges(spark, sf_dir), SIZE).select("site_id", "r", "c").distinct()
    return rounded(boundaries.overlap(predicted, reference, ["site_id"], ["r", "c"]), "iou", "f1", "precision", "recall")


@query("prior_strength", f"WITH {EDGES} SELECT DISTINCT poly_id, round(0.35::DOUBLE * power(0.5::DOUBLE, abs(2015 - source_year) / 5.0::DOUBLE), 9) AS strength FROM edges")
def prior_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = bridge.edges(spark, sf_dir).select("poly_id", "source_year").distinct()
    return rounded(own.select("poly_id", boundaries.prior_strength(F.lit(2015), F.col("source_year")).alias("strength")), "strength")


@query(
    "erode_polygon",
    f"""WITH {EDGES}, {RASTER}, e AS (SELECT a.poly_id, a.r, a.c FROM rst a JOIN rst b ON a.poly_id = b.poly_id AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY ALL HAVING count(*) = 9)
SELECT poly_id, r, c FROM e""",
)
def erode_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundaries.eroded(boundaries.rasterised(bridge.edges(spark, sf_dir), SIZE), ["poly_id"])


@query(
    "mask_outline",
    f"""WITH {PX}, {MASK}, d AS (SELECT * FROM (VALUES (0, -1, 0, 0, 1, 0), (1, 0, 1, 0, 1, 1), (0, 1, 1, 1, 0, 1), (-1, 0, 0, 1, 0, 0)) v(dc, dr, a, b, e, f))
SELECT m.site_id, m.area_num, m.c - 1 + a AS x1, m.r - 1 + b AS y1, m.c - 1 + e AS x2, m.r - 1 + f AS y2 FROM mask m, d
WHERE NOT EXISTS (SELECT 1 FROM mask n WHERE n.site_id = m.site_id AND n.area_num = m.area_num AND n.r = m.r + d.dr AND n.c = m.c + d.dc)""",
)
def mask_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundaries.outlines(mask_cells(spark, sf_dir), ["site_id", "area_num"])


@query(
    "polygon_support",
    f"""WITH {FX}, {EDGES}, {RASTER}, er AS (SELECT a.site_id, a.poly_id, a.r, a.c FROM rst a JOIN rst b ON a.site_id = b.site_id AND a.poly_id = b.poly_id AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY ALL HAVING count(*) = 9),
ins AS (SELECT * FROM er UNION ALL SELECT site_id, poly_id, r, c FROM rst WHERE NOT EXISTS (SELECT 1 FROM er WHERE er.site_id = rst.site_id AND er.poly_id = rst.poly_id)),
{LONG}, x AS (SELECT i.site_id, i.poly_id, l.w, l.v FROM lx l JOIN ins i USING (site_id, r, c) WHERE l.v IS NOT NULL),
m AS (SELECT site_id, poly_id, w, count(*) AS n, median(v) AS mu FROM x GROUP BY ALL),
d AS (SELECT x.site_id, x.poly_id, x.w, any_value(m.n) AS n, any_value(m.mu) AS mu, 1.4826::DOUBLE * median(abs(x.v - m.mu)) AS disp FROM x JOIN m USING (site_id, poly_id, w) GROUP BY ALL)
SELECT site_id, poly_id, w, n, round(CASE WHEN n >= 2 THEN mu END, 9) AS mu, round(CASE WHEN n >= 2 THEN disp END, 9) AS disp FROM d""",
)
def polygon_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every polygon with a signature of its own."""
    inside = boundaries.eroded(boundaries.rasterised(bridge.edges(spark, sf_dir), SIZE).select("site_id", "poly_id", "r", "c"), ["site_id", "poly_id"])
    own = long_values(spark, sf_dir).join(inside, ["site_id", "r", "c"])
    return rounded(signature.signature(own, ("site_id", "poly_id", "w")), "mu", "disp")


# -- grids and delineation -------------------------------------------------------------------------

ALIVE = "al AS (SELECT site_id, r, c FROM feat WHERE w1 >= 0.53)"


def _labels_sql(near: str) -> str:
    return f"""rc AS (SELECT site_id, r, c, r AS ar, c AS ac FROM al UNION SELECT al.site_id, al.r, al.c, rc.ar, rc.ac FROM rc JOIN al ON al.site_id = rc.site_id AND {near}),
fc AS (SELECT site_id, r, c, min(ac * 1000 + ar) AS f FROM rc GROUP BY ALL), lb AS (SELECT site_id, r, c, CAST(dense_rank() OVER (PARTITION BY site_id ORDER BY f) AS INT) AS label FROM fc)"""


_NEAR8 = "abs(al.r - rc.r) <= 1 AND abs(al.c - rc.c) <= 1"
_NEAR4 = "abs(al.r - rc.r) + abs(al.c - rc.c) = 1"


def alive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).where("w1 >= 0.53").select("site_id", "r", "c")


def _components(name: str, near: str, four: bool) -> None:
    @query(name, f"WITH RECURSIVE {FX}, {ALIVE}, {_labels_sql(near)} SELECT site_id, r, c, label FROM lb")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return delineate.labelled(alive(spark, sf_dir), seeds(spark), SIZE, SIZE, four)


_components("components8", _NEAR8, False)
_components("components4", _NEAR4, True)


@query(
    "area_rank",
    f"""WITH RECURSIVE {FX}, {ALIVE}, {_labels_sql(_NEAR4)}, s AS (SELECT site_id, label, count(*) AS size, CAST(min(greatest(abs(r - 12), abs(c - 12))) AS INT) AS min_dist FROM lb GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY site_id ORDER BY min_dist, size DESC, label) AS INT) AS area_num FROM s""",
)
def area_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.ranked(delineate.labelled(alive(spark, sf_dir), seeds(spark), SIZE, SIZE, True), seeds(spark))


@query(
    "seed_component",
    f"""WITH RECURSIVE {FX}, el AS (SELECT site_id, r, c FROM feat WHERE w1 BETWEEN 0.2 AND 1.2), rc AS (SELECT site_id, r, c FROM el WHERE r = 12 AND c = 12 UNION SELECT el.site_id, el.r, el.c FROM rc JOIN el ON el.site_id = rc.site_id AND abs(el.r - rc.r) <= 1 AND abs(el.c - rc.c) <= 1)
SELECT site_id, r, c FROM rc""",
)
def seed_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = params(local_alive_density=0.0, area_threshold=(0.2, 1.2), area_sensitivity=99.0, search_windows=(1,))
    return delineate.delineated(features(spark, sf_dir), seeds(spark), SIZE, SIZE, own, ("area",)).select("site_id", "r", "c")


@query(
    "area_envelope",
    f"""WITH RECURSIVE {FX}, {ALIVE}, {_labels_sql(_NEAR4)}
SELECT site_id, label, 'r' AS axis, r AS line, CAST(greatest(min(c) - 1, 1) AS INT) AS low, CAST(least(max(c) + 1, {SIZE}) AS INT) AS high FROM lb GROUP BY site_id, label, r
UNION ALL SELECT site_id, label, 'c', c, CAST(greatest(min(r) - 1, 1) AS INT), CAST(least(max(r) + 1, {SIZE}) AS INT) FROM lb GROUP BY site_id, label, c""",
)
def area_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.envelope(delineate.labelled(alive(spark, sf_dir), seeds(spark), SIZE, SIZE, True), SIZE)


@query(
    "area_perimeter",
    f"""WITH RECURSIVE {FX}, {ALIVE}, {_labels_sql(_NEAR4)} SELECT site_id, r, c, label FROM lb
WINDOW rw AS (PARTITION BY site_id, label, r), cw AS (PARTITION BY site_id, label, c) QUALIFY c = min(c) OVER rw OR c = max(c) OVER rw OR r = min(r) OVER cw OR r = max(r) OVER cw""",
)
def area_perimeter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.perimeter(delineate.labelled(alive(spark, sf_dir), seeds(spark), SIZE, SIZE, True))


@query(
    "label_bridge",
    f"""WITH RECURSIVE {FX}, {ALIVE}, {_labels_sql(_NEAR4)}, dd AS (SELECT site_id, r, c FROM feat WHERE w1 < 0.53)
SELECT dd.site_id, dd.r, dd.c, count(DISTINCT lb.label) AS labels FROM dd JOIN lb ON lb.site_id = dd.site_id AND abs(lb.r - dd.r) <= 1 AND abs(lb.c - dd.c) <= 1 GROUP BY ALL HAVING count(DISTINCT lb.label) >= 2""",
)
def label_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    dead = features(spark, sf_dir).where("w1 < 0.53").select("site_id", "r", "c")
    return grid.bridges(delineate.labelled(alive(spark, sf_dir), seeds(spark), SIZE, SIZE, True), dead)


_FIELD = params(area_threshold=(0.2, 1.5), area_sensitivity=0.35, interior_threshold=(0.1, 1.5))


@query("fill_density")
def fill_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delineate.delineated(features(spark, sf_dir), seeds(spark), SIZE, SIZE, _FIELD, ("area",))


@query("boundary_delineation")
def boundary_delineation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delineate.delineated(features(spark, sf_dir), seeds(spark), SIZE, SIZE, _FIELD)


@query("prior_delineation")
def prior_delineation(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = bridge.edges(spark, sf_dir)
    points = edges.select("site_id").distinct().select("site_id", F.lit(8.25).alias("x"), F.lit(7.75).alias("y"))
    cells = boundaries.prior(points, edges, SIZE, 2010)
    return delineate.delineated(features(spark, sf_dir), seeds(spark), SIZE, SIZE, _FIELD, prior=cells)


@query("delineated_series")
def delineated_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = boundary_delineation(spark, sf_dir).select("site_id", "r", "c")
    return rounded(series.series(values(spark, sf_dir).join(mask, ["site_id", "r", "c"], "left_semi"), "v", "monthly"), "value")


# -- batch -----------------------------------------------------------------------------------------

VISITS = """visits AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey % 400 AS DOUBLE) - 200.0 AS longitude, CAST(o_orderkey % 200 AS DOUBLE) - 100.0 AS latitude, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS start_date,
  CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 4 AS INT) AS VARCHAR) AS end_date FROM orders)"""


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = bridge.table(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date")
    return o.select(F.col("o_orderkey").cast("string").alias("id"), ((F.col("o_custkey") % 400).cast("double") - 200).alias("longitude"), ((F.col("o_orderkey") % 200).cast("double") - 100).alias("latitude"), day.cast("string").alias("start_date"), F.date_add(day, (F.col("o_orderkey") % 4).cast("int")).cast("string").alias("end_date"))


@query(
    "site_validation",
    f"""WITH {VISITS} SELECT id, CASE WHEN longitude NOT BETWEEN -180 AND 180 THEN 'longitude' WHEN latitude NOT BETWEEN -90 AND 90 THEN 'latitude'
  WHEN datediff('day', CAST(start_date AS DATE), CAST(end_date AS DATE)) < 2 THEN 'period' END AS invalid_reason FROM visits""",
)
def site_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visits(spark, sf_dir).select("id", batch.invalid_reason().alias("invalid_reason"))


@query(
    "batch_outcomes",
    f"""WITH {VX}, t AS (SELECT CAST(i AS VARCHAR) AS id FROM range(7) s(i)), s AS (SELECT CAST(site_id AS VARCHAR) AS id, count(DISTINCT scene_date) AS n FROM vx WHERE v > 0.2 AND site_id <> 3 GROUP BY ALL)
SELECT t.id, CASE WHEN t.id = '6' THEN 'failure' WHEN n IS NULL THEN 'empty' ELSE 'success' END AS status, coalesce(CASE WHEN t.id <> '6' THEN n END, 0) AS dates FROM t LEFT JOIN s USING (id)""",
)
def batch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = spark.range(7).select(F.col("id").cast("string").alias("id"))
    rows = series.scene_values(values(spark, sf_dir).where("v > 0.2 AND site_id != 3"), "v").select(F.col("site_id").cast("string").alias("id"), F.col("scene_date").alias("date"), "value")
    failed = spark.range(1).select(F.lit("6").alias("id"), F.lit("no scenes").alias("reason"))
    return batch.outcomes(sites, rows, failed).select("id", "status", "dates")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly series of the mean vegetation index of each site."""
    return QUERIES["series_monthly"](spark, sf_dir)


from . import registry_more  # noqa: E402, F401  the rest of the queries register themselves
