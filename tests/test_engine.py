"""Operators over tables, with hand-computed values."""

import datetime as dt
import struct

import pytest
from fieldloom.functions import geo, indices, reflectance
from fieldloom.operators import boundaries, catalogue, delineate, fusion, raster, series, signature
from fieldloom.operators.cache import ResultCache, cache_key
from fieldloom.plans import batch
from fieldloom.plans.params import DEFAULTS, Params, params, resolved
from fieldloom.plans.pipeline import Pipeline
from fieldloom.query import is_query, retrieve
from fieldloom.sources import catalogue as sources
from fieldloom.streaming.series import streaming_series
from pyspark.sql import functions as F


def one(df):
    return tuple(df.first())


def test_indices(spark):
    px = spark.createDataFrame([(0.4, 0.1, 0.05), (0.0, 0.0, 0.0)], "nir double, red double, blue double")
    rows = px.select(*(indices.index(n).alias(n) for n in ("NDVI", "EVI2", "EVI", "SR", "kNDVI"))).collect()
    assert abs(rows[0].NDVI - 0.6) < 1e-12 and abs(rows[0].EVI2 - 0.75 / 1.64) < 1e-12 and abs(rows[0].SR - 4) < 1e-12
    assert rows[1].NDVI is None and rows[1].SR is None and rows[1].kNDVI is None
    assert (len(indices.supported("sentinel-2")), len(indices.supported("landsat-8")), len(indices.supported("mcd43a4"))) == (31, 24, 14)
    with pytest.raises(ValueError, match="red"):
        indices.with_index(px.drop("red"), "NDVI")
    special = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,)], "v double")
    assert [r[0] for r in special.select(indices.finite(F.col("v"))).collect()] == [None, None, 1.0]


def test_reflectance(spark):
    dn = spark.createDataFrame([(1563, 1000), (1000, 1000), (563, 0), (12000, 1000)], "dn int, off int")
    got = [r[0] for r in dn.select(reflectance.reflectance(F.col("dn"), "sentinel-2", F.col("off"))).collect()]
    assert got[0] == got[2] == pytest.approx(0.0563) and got[1] is None and got[3] is None
    b = spark.createDataFrame([("05.10",), ("02.04",), (None,), ("x",)], "b string")
    assert [r[0] for r in b.select(reflectance.baseline_offset(F.col("b"))).collect()] == [1000, 0, None, None]
    m = spark.createDataFrame([(4,), (8,), (None,)], "m int")
    assert [r[0] for r in m.select(reflectance.clear_of_classes(F.col("m"), [8])).collect()] == [True, False, True]
    assert [r[0] for r in m.select(reflectance.clear_of_bits(F.col("m"), [3])).collect()] == [True, False, True]
    with pytest.raises(ValueError):
        reflectance.clear_of_classes(F.col("m"), [12])


def test_sources_of_dates():
    assert catalogue.check_source("auto", "2015-07-01") == "sentinel-2" and catalogue.check_source("auto", "2013-04-01") == "landsat-8" and catalogue.check_source("auto", "2000-01-01") == "landsat-5"
    with pytest.raises(ValueError):
        catalogue.check_source("sentinel-2", "2014-01-01")
    assert catalogue.check_source("landsat-5", "1980-01-01") == "landsat-5"


def test_processing_versions(spark):
    rows = [(1, "a", 5, 10, "g2"), (2, "a", 4, 0, "g9"), (3, "a", 5, 10, None), (4, "b", None, 0, "g"), (5, "b", 5, 0, "g"), (6, None, 1, 1, "g"), (7, None, 2, 1, "g")]
    items = spark.createDataFrame(rows, "item_id int, tile string, major int, minor int, generation string")
    ids = lambda order: sorted(r.item_id for r in catalogue.select_processing(items, ["tile"], order).collect())
    assert ids("highest_baseline") == [1, 4, 5, 6, 7] and ids("lowest_baseline") == [2, 4, 5, 6, 7]


def test_instants(spark):
    texts = ["2021-01-05T02:03:04.1234567890Z", "2021-01-05T02:03:04+01:30", "2021-02-30T00:00:00Z", "2021-01-05T02:03:04.000Z", "x", "2021-01-01T00:00:00+24:00"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(catalogue.acquisition_instant(F.col("t"))).collect()]
    assert got == ["2021-01-05T02:03:04.123456789Z", "2021-01-05T00:33:04Z", None, "2021-01-05T02:03:04Z", None, None]
    stripped = spark.createDataFrame([("at https://a.b/c?sig=1 x",)], "t string").select(catalogue.stripped_query(F.col("t"))).first()[0]
    assert stripped == "at https://a.b/c x"


def day(text):
    return dt.date.fromisoformat(text)


def test_mosaic_and_composites(spark):
    px = spark.createDataFrame([(1, 1, 1, 2, 5.0, None), (1, 1, 1, 1, None, 2.0), (1, 1, 1, 3, 7.0, 3.0), (1, 1, 2, 1, None, None)], "site_id int, r int, c int, o int, x double, y double")
    got = {(r.c): (r.x, r.y) for r in raster.mosaic(px, ["site_id", "r", "c"], ["x", "y"], "o").collect()}
    assert got == {1: (5.0, 2.0), 2: (None, None)}
    sums = {r.c: r.x for r in raster.composite(px, "x", "sum").collect()}
    assert sums == {1: 12.0, 2: None}
    assert raster.complete_dates(px, ["c"], ["x", "y"]).select("c").distinct().collect()[0].c == 1
    with pytest.raises(ValueError):
        raster.composite(px, "x", "mode")


def test_empty_mask_empties(spark):
    own = spark.createDataFrame([(1, 1, 1, 2.0)], "site_id int, r int, c int, v double")
    none = own.limit(0)
    assert raster.masked(own, none, "v", ["site_id", "r", "c"]).first().v is None


def test_refined_grid(spark):
    coarse = spark.createDataFrame([(1, r, c, float(10 * r + c)) for r in (1, 2) for c in (1, 2)], "site_id int, r int, c int, v double")
    got = {(r.r, r.c): r.v for r in raster.refined(coarse, "v", 2, ["site_id"]).collect()}
    assert got[(2, 2)] == pytest.approx(0.5625 * 11 + 0.1875 * (12 + 21) + 0.0625 * 22)
    assert got[(1, 1)] == pytest.approx(11)


def test_windows(spark):
    days = spark.createDataFrame([(day(f"2021-01-{k:02d}"),) for k in (1, 10, 11, 20, 21, 31)] + [(day("2021-02-01"),)], "d date")
    assert [r[0] for r in days.select(raster.window_number(F.col("d"), "2021-01-01", "2021-01-31", 3)).collect()] == [1, 1, 2, 2, 3, 3, None]
    assert [raster.window_count(n, 10) for n in (5, 20, 40, 400)] == [1, 2, 3, 3]


def test_series_average_scenes_not_pixels(spark):
    rows = [(1, day("2021-01-05"), 1.0), (1, day("2021-01-05"), 3.0), (1, day("2021-01-20"), 8.0), (1, day("2021-02-01"), None)]
    px = spark.createDataFrame(rows, "site_id int, scene_date date, v double")
    assert {r.date: r.value for r in series.series(px, "v", "monthly").collect()} == {"2021-01": 5.0}
    assert {r.date: r.value for r in series.series(px, "v", "yearly", "max").collect()} == {"2021": 8.0}
    assert {r.date: r.value for r in series.custom_series(px, "v", lambda x: x.max(), "monthly").collect()} == {"2021-01": 8.0}
    both = spark.createDataFrame([(1, day("2021-01-05"), True, 9.0), (1, day("2021-01-05"), False, 1.0), (1, day("2021-01-06"), True, 2.0)], "site_id int, scene_date date, is_fused boolean, value double")
    assert sorted(r.value for r in series.observed_first(both).collect()) == [1.0, 2.0]


def test_signatures(spark):
    v = spark.createDataFrame([(1, 1, x) for x in (1.0, 2.0, 4.0, None)] + [(1, 2, 5.0)], "site_id int, w int, v double")
    got = {r.w: (r.n, r.mu, r.disp) for r in signature.signature(v).collect()}
    assert got[1] == (3, 2.0, pytest.approx(1.4826)) and got[2] == (1, None, None)
    t = spark.createDataFrame([(0.1, 9), (None, 9), (0.2, 2), (0.5, 9)], "d double, n int")
    tol, reason = signature.tolerance(F.col("d"), F.col("n"), 2.2, 0.3, 5, 0.2, 0.7)
    assert [tuple(r) for r in t.select(tol, reason).collect()] == [(0.3, None), (None, "disp_na"), (pytest.approx(0.44), "n_below_min"), (1.1, "disp_crossover")]
    assert signature.noise_floor("NDVI") > 0 and signature.noise_floor("EVI2") > 0 and signature.noise_floor("NBR") is None
    few = spark.createDataFrame([(1, 1, float(x)) for x in range(7)], "site_id int, w int, v double")
    assert signature.mode_gap(few, 0.1).first().sep is None


def test_anchors(spark):
    fine = spark.createDataFrame([(1, day("2021-01-10")), (1, day("2021-01-20"))], "site_id int, scene_date date")
    coarse = spark.createDataFrame([(1, day(f"2021-01-{k}")) for k in (11, 13, 15, 16, 21)], "site_id int, scene_date date")
    assert [str(r.scene_date) for r in fusion.uncovered(coarse, fine).orderBy("scene_date").collect()] == ["2021-01-15", "2021-01-16"]
    got = {str(r.scene_date): (str(r.anchor), str(r.partner), r.anchor_days) for r in fusion.anchored(coarse, fine).collect()}
    assert got == {"2021-01-15": ("2021-01-10", "2021-01-11", 5), "2021-01-16": ("2021-01-20", "2021-01-21", 4)}  # the tie goes to the earlier


def test_delta(spark):
    rows = [(0.4, 0.4, 0.5, 0.0), (0.95, 0.95, 1.2, 0.0), (0.1, 0.1, -0.2, 0.0), (0.5, 0.3, 0.6, 0.2)]
    got = [r[0] for r in spark.createDataFrame(rows, "f double, p double, q double, m double").select(fusion.delta(F.col("f"), F.col("p"), F.col("q"), F.col("m"))).collect()]
    assert got == [pytest.approx(0.5), 1.0, 0.0, 0.5]


def test_agreement(spark):
    pairs = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 3.0), (1, 3.0, 4.0), (2, 1.0, 1.0), (3, 1.0, 1.0), (3, 1.0, 2.0)], "k int, obs double, pred double")
    got = {r.k: (r.rmse, r.mae, r.bias, r.r, r.n) for r in fusion.agreement(pairs, ["k"], 1).collect()}
    assert got[1] == (1.0, 1.0, 1.0, pytest.approx(1.0), 3) and got[2][3] is None and got[3][3] is None
    assert fusion.agreement(pairs, ["k"]).where("rmse is not null").count() == 0


def test_geometry(spark):
    p = spark.createDataFrame([(117.8, -32.0), (6.0, 60.0), (15.0, 75.0), (180.0, 0.0), (0.0, 85.0)], "lon double, lat double")
    assert [r[0] for r in p.select(geo.utm_epsg(F.col("lon"), F.col("lat"))).collect()] == [32750, 32632, 32633, 32660, None]
    x, y = geo.utm(F.lit(9.0), F.lit(0.0), F.lit(32632))
    assert one(p.limit(1).select(x, y)) == (pytest.approx(500000, abs=1e-6), pytest.approx(0, abs=1e-6))
    x, y = geo.utm(F.lit(2.2945), F.lit(48.8582), F.lit(32631))
    assert one(p.limit(1).select(x, y)) == (pytest.approx(448251.795, abs=0.01), pytest.approx(5411932.678, abs=0.01))
    box = geo.bbox(F.lit(0.0), F.lit(0.0), F.lit(111319.49), F.lit(110574.3))
    b = p.limit(1).select(box.alias("b")).first().b
    assert b.xmax - b.xmin == pytest.approx(1, abs=1e-4) and b.ymax - b.ymin == pytest.approx(1, abs=1e-5)
    assert p.limit(1).select(geo.bbox(F.lit(179.99), F.lit(0.0), F.lit(9999.0), F.lit(9999.0)).alias("b")).first().b is None


def square(x0, y0, x1, y1):
    ring = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    return struct.pack("<BII", 1, 3, 1) + struct.pack("<I", 5) + b"".join(struct.pack("<dd", *p) for p in ring)


def test_boundaries(spark, tmp_path):
    rows = [(1, 2010, bytearray(square(8, 8, 22, 22))), (2, 2020, bytearray(square(50, 50, 60, 60))), (3, 2020, None)]
    spark.createDataFrame(rows, "poly_id long, source_year int, geometry binary").write.parquet(str(tmp_path / "b"))
    edges = sources.boundaries(spark, str(tmp_path / "b"), (0, 0, 30, 30)).withColumn("site_id", F.lit(1))
    cells = boundaries.rasterised(edges, 30)
    assert edges.select("poly_id").distinct().count() == 1 and cells.count() == 196
    assert cells.agg(F.min("r"), F.max("r"), F.min("c"), F.max("c")).first()[:] == (9, 22, 9, 22)
    again = cells.where("r > 15")
    o = boundaries.overlap(again, cells, ["site_id"], ["r", "c"]).first()
    assert (o.n_pred, o.n_ref, o.n_intersection, o.precision, o.iou) == (98, 196, 98, 1.0, 0.5)
    apart = boundaries.overlap(cells, cells.withColumn("r", F.col("r") + 30), ["site_id"], ["r", "c"]).first()
    assert apart.iou == 0 and apart.f1 == 0
    points = spark.createDataFrame([(1, 10.0, 10.0)], "site_id int, x double, y double")
    assert one(boundaries.selected(points, edges)) == (1, 1)
    years = spark.createDataFrame([(2015, 2010), (2015, None)], "a int, b int")
    assert [r[0] for r in years.select(boundaries.prior_strength(F.col("a"), F.col("b"))).collect()] == [pytest.approx(0.175), 0.0]


@pytest.mark.parametrize("bad", [{"trace_iter": True}, {"area_threshold": (0.7, 0.2)}, {"perimeter_margins": (0.5, 0.5)}, {"area_sensitivity": float("nan")}, {"search_windows": (1, 1)}, {"strictness": "x"}, {"search_start_date": "01/05/2021"}, {"multiple_areas": 1}, {"local_alive_density": 1.5}, {"search_start_date": "2021-02-01", "search_end_date": "2021-01-01"}])
def test_settings_are_checked(bad):
    with pytest.raises(ValueError):
        params(**bad)


def test_ownership():
    stored = params(area_sensitivity=0.2)
    assert resolved(stored, calibrated=0.05).area_sensitivity == 0.2
    assert resolved(DEFAULTS, calibrated=0.05).area_sensitivity == 0.05
    assert resolved(params(trace_iter=5), Params()).trace_iter == 5  # an untouched object changes nothing
    assert resolved(params(trace_iter=5), {"trace_iter": 20}).trace_iter == 20  # a dict owns what it names
    assert resolved(DEFAULTS, params(trace_iter=7), {"trace_iter": 9}).trace_iter == 9
    assert resolved(DEFAULTS, None, {"split_sensitivity": None}).split_sensitivity is None
    with pytest.raises(ValueError):
        resolved(DEFAULTS, {"search_index": "NDVI"})


def scenes(spark):
    rows = [(1, day(d), r, c, 0.5 + (0.2 if 5 <= r <= 15 and 5 <= c <= 15 else 0), 0.1 if 5 <= r <= 15 and 5 <= c <= 15 else 0.45) for d in ("2021-01-05", "2021-01-20", "2021-02-10") for r in range(1, 21) for c in range(1, 21)]
    return spark.createDataFrame(rows, "site_id int, scene_date date, r int, c int, nir double, red double")


def test_chain(spark):
    seeds = spark.createDataFrame([(1, 10, 10, 9)], "site_id int, r0 int, c0 int, rmax int")
    q = retrieve(scenes(spark), seeds, 20, 20, "2021-01-01", "2021-03-01", "EVI2", "auto", params(area_threshold=(0.2, 0.9)))
    assert is_query(q) and q.source == "sentinel-2" and q.mask() is None and "EVI2" in repr(q)
    done = q.boundary_delineation()
    mask = done.mask()
    assert mask.count() == 121 and mask.agg(F.min("r"), F.max("r")).first()[:] == (5, 15)
    value = 2.5 * 0.6 / (0.7 + 0.24 + 1)
    got = done.as_time_series("monthly").collect()
    assert sorted(r.date for r in got) == ["2021-01", "2021-02"] and all(r.value == pytest.approx(value) for r in got)
    image = done.as_raster()
    assert image.count() == 400 and image.where("v is not null").count() == 121
    assert q.as_raster().where("v is not null").count() == 400
    with pytest.raises(ValueError):
        q.split_area()
    for bad in ({"start": "2021-01-01", "end": "2021-01-02"}, {"index_name": "XX"}, {"source": "sentinel-2", "start": "2014-01-01"}):
        with pytest.raises(ValueError):
            retrieve(scenes(spark), seeds, 20, 20, **{"start": "2021-01-01", "end": "2021-03-01"} | bad)


def test_prior_chain(spark):
    seeds = spark.createDataFrame([(1, 10, 10, 9)], "site_id int, r0 int, c0 int, rmax int")
    q = retrieve(scenes(spark), seeds, 20, 20, "2021-01-01", "2021-03-01", "EVI2", "auto", params(area_threshold=(0.2, 0.9)))
    cells = q.scenes.where("r BETWEEN 5 AND 15 AND c BETWEEN 5 AND 15").select("site_id", "r", "c", F.lit(0.3).alias("strength")).distinct()
    done = q.add_prior(cells).boundary_delineation()
    assert {r.w: r.n for r in done.calibration().collect()} == {1: 81, 3: 81}  # no scene falls in the second window
    assert done.diagnose().first().iou == 1.0
    border = done.outlines()
    assert border.count() == 44 and border.agg(F.min("x1"), F.max("x2")).first()[:] == (4, 15)
    again = done.segment_area()
    assert again.mask().count() == 121
    thin = cells.where("r = 7")
    assert boundaries.eroded(thin, ["site_id"]).count() == 11  # would vanish, so it stays
    with pytest.raises(ValueError):
        q.diagnose()


def test_fused_chain(spark):
    seeds = spark.createDataFrame([(1, 10, 10, 9)], "site_id int, r0 int, c0 int, rmax int")
    far = scenes(spark)
    coarse = far.withColumn("scene_date", F.date_add("scene_date", 1)).unionByName(far.where("scene_date = '2021-01-05'").withColumn("scene_date", F.lit("2021-01-12").cast("date")).withColumn("nir", F.col("nir") + 0.1))
    q = retrieve(far, seeds, 20, 20, "2021-01-01", "2021-03-01", "NDVI", "landsat-8", Params(search_index="NDVI"))
    fused = q.add_coarse(coarse)
    assert fused.fused and fused.add_coarse(coarse) is fused
    made = fused.scenes.where("is_fused").groupBy("scene_date", "anchor_days").count().collect()
    assert [(str(r.scene_date), r.anchor_days, r["count"]) for r in made] == [("2021-01-12", 7, 400)]
    assert fused.as_time_series().where("is_fused").count() == 1
    assert q.validate_fusion(coarse).count() == 3
    beside = q.validate_fusion(coarse, "series")
    assert beside.count() == 3 and {"date", "value", "rmse"} <= set(beside.columns)


def test_pipeline_and_batch(spark):
    def stage(data, factor=1, context=0):
        return data.withColumn("value", F.lit(float(factor + context))).withColumn("date", F.lit("2021-01-01")).select("id", "date", "value")

    chain = Pipeline().then(stage, factor=3)
    assert repr(chain) == "stage(factor=3)"
    sites = spark.createDataFrame([("a", 117.1, -32.0, "2021-01-01", "2021-02-01"), ("b", 200.0, 0.0, "2021-01-01", "2021-02-01"), ("c", 1.0, 1.0, "2021-01-01", "2021-01-02")], "id string, longitude double, latitude double, start_date string, end_date string")
    rows, failures, outcome = batch.batch(sites, chain, context=2)
    assert [tuple(r) for r in rows.collect()] == [("a", "2021-01-01", 5.0)]
    assert {r.id: r.reason for r in failures.collect()} == {"b": "longitude", "c": "period"}
    assert {r.id: r.status for r in outcome.collect()} == {"a": "success", "b": "failure", "c": "failure"}
    with pytest.raises(ValueError):
        Pipeline()(sites)


def test_retries():
    calls, slept = [], []

    def read():
        calls.append(1)
        if len(calls) < 4:
            raise TimeoutError
        return "done"

    assert batch.fetched(read, sleep=slept.append) == "done" and slept == [2, 4, 8]
    with pytest.raises(ValueError):
        batch.fetched(lambda: (_ for _ in ()).throw(ValueError("no such collection")), sleep=slept.append)
    assert batch.is_transient(RuntimeError("HTTP 503")) and not batch.is_transient(RuntimeError("HTTP 404")) and batch.pause(9) == 60


def test_cache(spark, tmp_path):
    cache = ResultCache(spark, str(tmp_path / "c"), most=2)
    made = []
    make = lambda n: lambda: (made.append(n), spark.range(n))[1]
    assert cache.get({"longitude": 1.00000001}, make(3)).count() == 3 and cache.get({"longitude": 1.00000002}, make(4)).count() == 3 and made == [3]
    for k in range(3):
        cache.write(cache_key({"k": k}), spark.range(1))
    assert len(cache.entries()) == 2 and cache.clear() == 2 and cache.entries() == []
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x").write_text("mine")
    with pytest.raises(ValueError):
        ResultCache(spark, str(tmp_path / "d")).own()


def test_components_by_site(spark):
    rows = [(s, r, c) for s in (1, 2) for r, c in ((1, 1), (2, 2), (5, 5))]
    got = delineate.labelled(spark.createDataFrame(rows, "site_id int, r int, c int"), None, 6, 6).collect()
    assert {(r.site_id, r.r, r.label) for r in got} == {(s, r, 1 if r < 5 else 2) for s in (1, 2) for r in (1, 2, 5)}


def test_stac_source(spark):
    spark.dataSource.register(sources.StacSource)
    reader = sources._StacReader({"search": "m:f", "collection": "c", "start": "2021-01-01", "end": "2021-03-15"})
    assert [(p.start, p.end) for p in reader.partitions()] == [("2021-01-01", "2021-01-31"), ("2021-02-01", "2021-03-03"), ("2021-03-04", "2021-03-15")]
    with pytest.raises(ValueError):
        sources._StacReader({})


def test_stream(spark, tmp_path):
    rows = [(1, dt.datetime(2021, 1, d, 3), float(d)) for d in (1, 1, 2, 9)]
    spark.createDataFrame(rows, "site_id int, instant timestamp, v double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("site_id int, instant timestamp, v double").parquet(str(tmp_path / "in"))
    query = streaming_series(stream, "v").writeStream.format("memory").queryName("zonal").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert {(str(r.start)[:10], r.value, r.n) for r in spark.table("zonal").collect()} == {("2021-01-01", 1.0, 2), ("2021-01-02", 2.0, 1)}


def test_support_widens_to_the_grid(spark):
    """Noise that a square of radius 8 doesn't measure: the radius is about 11 where that is enough, else the grid's limit."""
    wide = [(1, r, c, 0.4 + 0.05 * ((7 * r + 13 * c) % 5)) for r in range(1, 41) for c in range(1, 41)]
    cells = spark.createDataFrame(wide, "site_id int, r int, c int, w1 double")
    seeds = spark.createDataFrame([(1, 20, 20, 19)], "site_id int, r0 int, c0 int, rmax int")
    se = lambda radius: signature.SE_SCALE * signature.MAD_SCALE * 0.05 / (2 * radius + 1)
    at = lambda floor: signature.support(cells, seeds, floor, 1).first().radius
    assert 9 <= at(1.1 * se(11)) <= 13 and at(1e-6) == 19
    two = cells.withColumn("w2", F.when((F.abs(F.col("r") - 20) > 14) & (F.col("c") == 20), 0.3))
    assert signature.support(two, seeds, 1.0, 2).first().radius == 15  # a window measurable further out only
    none = cells.withColumn("w1", F.lit(None).cast("double"))
    assert signature.support(none, seeds, 1.0, 1).first().radius == 2


def test_fused_series_has_anchor_diagnostics(spark):
    rows = lambda d, nirs: [(1, day(d), r, c, nirs[c - 1], 0.1) for r in (1, 2) for c in (1, 2)]
    kind = "site_id int, scene_date date, r int, c int, nir double, red double"
    fine = spark.createDataFrame(rows("2021-01-05", (0.5, 0.7)), kind)
    coarse = spark.createDataFrame(rows("2021-01-06", (0.4, 0.4)) + rows("2021-01-12", (0.5, 0.5)), kind)
    seeds = spark.createDataFrame([(1, 1, 1, 0)], "site_id int, r0 int, c0 int, rmax int")
    q = retrieve(fine, seeds, 2, 2, "2021-01-01", "2021-03-01", "NDVI", "landsat-8", Params(search_index="NDVI")).add_coarse(coarse)
    ndvi = lambda nir: (nir - 0.1) / (nir + 0.1)
    apart = [ndvi(0.5) - ndvi(0.4), ndvi(0.7) - ndvi(0.4)]
    mae, mean = sum(apart) / 2, (ndvi(0.5) + ndvi(0.7)) / 2
    for every in ("daily", "monthly"):
        got = {r.is_fused: r for r in q.as_time_series(every).collect()}
        assert got[False].anchor_days is got[False].anchor_mae is got[False].anchor_nmae is None
        assert (got[True].anchor_days, got[True].anchor_mae, got[True].anchor_nmae) == (7, pytest.approx(mae), pytest.approx(mae / mean))
    mask = spark.createDataFrame([(1, r, c, c) for r in (1, 2) for c in (1, 2)], "site_id int, r int, c int, area_num int")
    by_area = {r.is_fused: r for r in q.as_time_series("monthly", mask=mask, areas=[1, 2]).collect()}
    assert by_area[False].area_1 == pytest.approx(ndvi(0.5)) and by_area[False].area_2 == pytest.approx(ndvi(0.7))
    assert by_area[True].anchor_mae == pytest.approx(mae) and by_area[True].area_1 is not None
    one_area = q.as_time_series(mask=mask.where("c = 2")).where("is_fused").first()
    assert one_area.anchor_mae == pytest.approx(apart[1])
