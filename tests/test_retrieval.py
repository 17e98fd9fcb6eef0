"""Retrieval, grids, polygons, batch rounds, calibration memory and the SQL surface on hand-made tables."""

import numpy as np
import pytest
from fieldloom.functions import geo
from fieldloom.operators import boundaries, delineate, georef, kernel, retrieval
from fieldloom.plans import batch, sql
from fieldloom.plans.calibration import Invocation, snapshot
from fieldloom.plans.params import params
from fieldloom.query import get_scenes, retrieve
from pyspark.sql import functions as F


def squares(*boxes):
    """Edges of rectangles (site, polygon, x1, y1, x2, y2)."""
    out = []
    for s, p, a, b, c, d in boxes:
        ring = [(a, b), (c, b), (c, d), (a, d), (a, b)]
        out += [(s, p, float(x1), float(y1), float(x2), float(y2)) for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False)]
    return out


EDGE = "site_id int, poly_id int, x1 double, y1 double, x2 double, y2 double"


def test_touched_cells(spark):
    """Against a fine sampling of the polygon; borders along cells' sides don't count."""
    rows = squares((1, 1, 1.2, 1.4, 3.6, 2.5), (1, 2, 1, 1, 3, 3))
    triangle = [(5.1, 1.2), (9.7, 2.4), (6.2, 6.9), (5.1, 1.2)]
    rows += [(1, 3, *a, *b) for a, b in zip(triangle, triangle[1:], strict=False)]
    got = {}
    for r in boundaries.touched(spark.createDataFrame(rows, EDGE), 12).collect():
        got.setdefault(r.poly_id, set()).add((r.r, r.c))
    assert got[1] == {(r, c) for r in (2, 3) for c in (2, 3, 4)} and got[2] == {(r, c) for r in (2, 3) for c in (2, 3)}
    (x1, y1), (x2, y2), (x3, y3) = triangle[:3]
    side = lambda ax, ay, bx, by, x, y: (bx - ax) * (y - ay) - (by - ay) * (x - ax)
    xs = np.arange(0, 12, 0.01) + 0.005
    x, y = np.meshgrid(xs, xs)
    inside = (side(x1, y1, x2, y2, x, y) >= 0) & (side(x2, y2, x3, y3, x, y) >= 0) & (side(x3, y3, x1, y1, x, y) >= 0)
    sampled = {(int(b) + 1, int(a) + 1) for a, b in zip(x[inside], y[inside], strict=True)}
    assert sampled <= got[3] and len(got[3] - sampled) <= 2


def test_rings_are_closed(spark):
    """Two areas that touch by a corner, and one with a hole: rings read back to the same cells."""
    ring = [(r, c) for r in range(1, 6) for c in range(1, 6) if (r, c) != (3, 3)]
    cells = [(1, 1, r, c) for r, c in ring] + [(1, 2, 8, 8), (1, 2, 9, 9), (1, 2, 9, 10)]
    mask = spark.createDataFrame(cells, "site_id int, area_num int, r int, c int")
    found = {}
    for row in boundaries.ring_texts(boundaries.outlines(mask, ["site_id", "area_num"]), ["site_id", "area_num"]).collect():
        points = [tuple(map(float, p.split())) for p in row.wkt[len("POLYGON ((") : -2].split(", ")]
        assert points[0] == points[-1] and len(points) > 4
        found.setdefault(row.area_num, []).append(points)
    assert sorted(len(x) for x in found[1]) == [5, 5] and len(found[2]) == 2
    for number, rings in found.items():
        size = sum(sum(a * d - c * b for (a, b), (c, d) in zip(x, x[1:], strict=False)) / 2 for x in rings)
        assert size == sum(1 for _, n, _, _ in cells if n == number)


def test_smallest_polygon_wins_whatever_else_shares_it(spark):
    edges = spark.createDataFrame(squares((0, 1, 0, 0, 20, 20), (0, 2, 2, 2, 9, 9)), EDGE).drop("site_id")
    points = spark.createDataFrame([(k, 3.0 + k, 4.0) for k in range(4)] + [(9, 15.0, 15.0), (10, None, 1.0), (11, 30.0, 1.0)], "site_id int, x double, y double")
    got = {r.site_id: r.poly_id for r in boundaries.selected(points, boundaries.of_points(points, edges)).collect()}
    assert got == {0: 2, 1: 2, 2: 2, 3: 2, 9: 1}


def test_masks_are_checked(spark):
    with pytest.raises(ValueError, match="needs the columns"):
        boundaries.check_mask(spark.range(1))
    with pytest.raises(ValueError, match="empty"):
        boundaries.check_mask(spark.createDataFrame([], "site_id int, r int, c int"))


def grid(spark, *rows):
    return spark.createDataFrame(rows, "site_id int, epsg int, nrow int, ncol int, xmin double, ymax double, res_x double, res_y double")


def test_aligned_moves_only_what_differs(spark):
    """Two sites, one half a cell off: the first stays as it is, the second is weighed from its neighbours."""
    cells = spark.createDataFrame([(s, r, c, float(10 * r + c)) for s in (1, 2) for r in (1, 2) for c in (1, 2)], "site_id int, r int, c int, v double")
    source = grid(spark, (1, 32750, 2, 2, 0.0, 20.0, 10.0, 10.0), (2, 32750, 2, 2, 0.0, 20.0, 10.0, 10.0))
    target = grid(spark, (1, 32750, 2, 2, 0.0, 20.0, 10.0, 10.0), (2, 32750, 2, 2, 5.0, 20.0, 10.0, 10.0))
    got = {(r.site_id, r.r, r.c): r.v for r in georef.aligned(cells, ["v"], source, target).collect()}
    assert {k: v for k, v in got.items() if k[0] == 1} == {(1, r, c): 10.0 * r + c for r in (1, 2) for c in (1, 2)}
    assert got[(2, 1, 1)] == 11.5 and got[(2, 2, 1)] == 21.5 and got[(2, 1, 2)] == 12.0


def test_projection_to_another_system(spark):
    """A geographic grid looks up UTM cells: its centre's cell, near and bilinear."""
    point = spark.createDataFrame([(1, 117.8, -32.0)], "site_id int, lon double, lat double")
    box = georef.analysed_box(point, F.lit(200.0), F.lit(200.0)).first()
    assert box.epsg == 32750 and abs(box.box.xmax - box.box.xmin - 200) < 1e-9
    source = grid(spark, (1, 32750, 20, 20, box.box.xmin, box.box.ymax, 10.0, 10.0))
    cells = spark.createDataFrame([(1, r, c, float(100 * r + c)) for r in range(1, 21) for c in range(1, 21)], "site_id int, r int, c int, v double")
    target = grid(spark, (1, 4326, 1, 1, 117.8 - 1e-5, -32.0 + 1e-5, 2e-5, 2e-5))
    smooth = georef.projected(cells, ["v"], source, target).first().v
    near = georef.projected(cells, ["v"], source, target, "near").first().v
    assert abs(smooth - (100 * 10.5 + 10.5)) < 0.01 and near in {1010.0, 1011.0, 1110.0, 1111.0}
    with pytest.raises(ValueError, match="method"):
        georef.projected(cells, ["v"], source, target, "cubic")


def test_padding_and_areas(spark):
    one = spark.createDataFrame([(179.99, 89.99)], "x double, y double").select(geo.padded(F.struct(F.col("x").alias("xmin"), F.col("y").alias("ymin"), F.col("x").alias("xmax"), F.col("y").alias("ymax"))).alias("b")).first().b
    assert one.xmax == 180 and one.ymax == 90 and abs(one.xmin - (179.99 - 5000 / 111320)) < 1e-12
    whole = spark.range(1).select((geo.parallel_area(F.lit(90.0)) - geo.parallel_area(F.lit(-90.0))).alias("a")).first().a * 2 * np.pi
    assert abs(whole - 510_065_621_724_000) < 1e9  # the ellipsoid's surface


ITEM = "item_id int, datetime string, start_datetime string, platform string, cloud double, xmin double, ymin double, xmax double, ymax double, assets map<string,string>, mgrs_tile string, relative_orbit int, baseline string, generation string"


def scene_tables(spark):
    def item(k, day, baseline, tile="50HMK", cloud=10.0):
        return (k, f"{day}T02:00:00Z", None, "sentinel-2a", cloud, 117.7, -32.1, 117.9, -31.9, {b: f"s3://x/{k}/{b}?q=1" for b in ("B04", "B08", "SCL")}, tile, 1, baseline, "g")

    items = [item(1, "2021-01-05", "05.10"), item(2, "2021-01-05", "02.04"), item(3, "2021-01-05", "05.10", "50HMJ"), item(4, "2021-01-20", "02.04"), item(5, "2021-01-21", "02.04", cloud=90.0)]
    dn = []
    for k, offset in ((1, 1000), (2, 0), (3, 1000), (4, 0), (5, 0)):
        for r in (1, 2):
            for c in (1, 2):
                if k == 3 and c == 1:
                    continue
                dn += [(f"s3://x/{k}/B04", r, c, 563 + offset), (f"s3://x/{k}/B08", r, c, 3000 + 100 * k + offset), (f"s3://x/{k}/SCL", r, c, 8 if k == 1 and (r, c) == (1, 1) else 4)]
    sites = spark.createDataFrame([(1, 117.8, -32.0)], "site_id int, longitude double, latitude double")
    return sites, spark.createDataFrame(items, ITEM), spark.createDataFrame(dn, "href string, r int, c int, dn int")


def test_scenes_of_a_site(spark):
    """Offset by item, the better processing version, masked pixels not filled from the other, tiles of a day merged."""
    sites, items, dn = scene_tables(spark)
    rows = retrieval.scenes(sites, items, dn, "sentinel-2", "2021-01-01", "2021-02-01", ("NDVI",), mask=[8]).collect()
    got = {(str(r.scene_date), r.r, r.c): r.nir for r in rows}
    assert got[("2021-01-05", 1, 1)] is None and got[("2021-01-05", 1, 2)] == pytest.approx(0.31) and got[("2021-01-20", 2, 2)] == pytest.approx(0.34)
    assert {d for d, _, _ in got} == {"2021-01-05", "2021-01-20"} and all(r.red == pytest.approx(0.0563) for r in rows if r.red is not None)
    low = retrieval.scenes(sites, items, dn, "sentinel-2", "2021-01-01", "2021-02-01", ("NDVI",), mask=[8], order="lowest_baseline").where("scene_date = '2021-01-05' and r = 1 and c = 1").first()
    assert low.nir == pytest.approx(0.32)


def test_chain_from_catalogue_to_mask(spark):
    sites, items, dn = scene_tables(spark)
    grids = grid(spark, (1, 4326, 2, 2, 117.7985, -31.9985, 0.001, 0.001))
    q = get_scenes(sites, items, dn, grids, "2021-01-01", "2021-02-01", "NDVI", mask=[8], params=params(search_index="NDVI"))
    assert q.source == "sentinel-2" and q.seeds.first().asDict() == {"site_id": 1, "r0": 2, "c0": 2, "rmax": 0, "nrow": 2, "ncol": 2}
    cells = {(r.r, r.c) for r in q.segment_area(area_threshold=(0.1, 0.9), area_sensitivity=0.5, time_independent_windows=False).mask().collect()}
    assert cells == {(1, 1), (1, 2), (2, 1), (2, 2)}
    far, near = (get_scenes(sites, items, dn, grid(spark, (1, 4326, 2, 2, west, -31.9985, 0.001, 0.001)), "2021-01-01", "2021-02-01") for west in (10.0, 117.8022))
    assert far.seeds.count() == 0 and far.scenes.count() == 0  # the box misses the grid
    out = near
    with pytest.raises(Exception, match="outside its grid"):
        out.seeds.collect()
    for bad in ({"index_name": "XYZ"}, {"x_metres": -1}, {"max_cloud": 101}, {"end": "2021-01-02"}, {"source": "landsat-5x"}):
        with pytest.raises(ValueError):
            get_scenes(**{"sites": sites, "items": items, "pixels": dn, "grids": grids, "start": "2021-01-01", "end": "2021-02-01"} | bad)


def field(spark, kind="string"):
    rows = [("a", d, r, c, 0.6 if 5 <= r <= 17 and 5 <= c <= 17 else 0.1, 0.1) for d in ("2021-01-05", "2021-01-20") for r in range(1, 22) for c in range(1, 22)]
    px = spark.createDataFrame(rows, "site_id string, d string, r int, c int, nir double, red double").withColumn("scene_date", F.to_date("d")).drop("d")
    return px, spark.createDataFrame([("a", 11, 11, 10)], "site_id string, r0 int, c0 int, rmax int")


def test_text_site_ids_and_cleanup_count(spark):
    px, seeds = field(spark)
    q = retrieve(px, seeds, 21, 21, "2021-01-01", "2021-01-31")
    own = q.boundary_delineation(cleanup_boundary=0, vi_sensitivity=0.3, vi_threshold=(0.2, 1.2))
    cells = own.mask()
    assert cells.schema["site_id"].dataType.simpleString() == "string" and cells.count() > 100 and {r.site_id for r in cells.select("site_id").distinct().collect()} == {"a"}
    for bad in (-1, 6, True, 1.5):
        with pytest.raises(ValueError, match="cleanup_boundary"):
            q.boundary_delineation(cleanup_boundary=bad)


def test_stages_keep_their_settings(spark, monkeypatch):
    px, seeds = field(spark)
    q = retrieve(px, seeds, 21, 21, "2021-01-01", "2021-01-31").trace_perimeter(trace_iter=3).segment_area(area_sensitivity=0.3).trace_perimeter(perimeter_margins=(0.3, 0.9), trace_iter=7)
    assert [(s.name, s.params.trace_iter, s.params.perimeter_margins, s.params.area_sensitivity) for s in q.stages] == [("trace", 3, (0.5, 0.9), 0.2), ("area", 20, (0.5, 0.9), 0.3), ("trace", 7, (0.3, 0.9), 0.2)]
    asked, plain = [], kernel.cleanup

    def noted(mask, decided, seed, values, iterations, *rest):
        asked.append((values, iterations))
        return plain(mask, decided, seed, values, iterations, *rest)

    monkeypatch.setattr(kernel, "cleanup", noted)
    cube = np.full((12, 12, 1), 0.5)
    site = kernel.Site(cube, (5, 5), params())
    for stage in q.stages:
        stage.run(site, q.params)
    assert asked == [((0.5, 0.9), 3), ((0.3, 0.9), 7)]
    asked.clear()
    delineate.Stage("boundary", params(trace_iter=4), 0).run(kernel.Site(cube, (5, 5), params(trace_iter=4)), params())
    assert [n for _, n in asked] == [4] * 6 and [v for v, _ in asked][-2:] == [(0.3, 0.9), (0.5, 0.5, 1)]


def test_boundary_on_a_mask_starts_anew():
    site = kernel.Site(np.full((12, 12, 1), 0.5), (5, 5), params()).area()
    site.decided[:] = True
    site.staged = ((0.1, 0.2), 1)
    site.boundary(0)
    assert not site.decided.all() and site.staged is None


def test_views_summaries_and_late_bands(spark, tmp_path):
    sites, items, dn = scene_tables(spark)
    blue = [(f"s3://x/{k}/B02", r, c, 600) for k in (2, 4) for r in (1, 2) for c in (1, 2)]
    items = items.withColumn("assets", F.map_concat("assets", F.create_map(F.lit("B02"), F.concat(F.lit("s3://x/"), F.col("item_id"), F.lit("/B02")))))
    dn = dn.unionByName(spark.createDataFrame(blue, dn.schema))
    grids = grid(spark, (1, 4326, 2, 2, 117.7985, -31.9985, 0.001, 0.001))
    q = get_scenes(sites, items, dn, grids, "2021-01-01", "2021-02-01", "NDVI", params=params(search_index="NDVI"))
    told = q.summary()
    assert told["bands"] == ["red", "nir"] and told["stages"] == [] and told["source"] == "sentinel-2" and told["windows"] == 2
    late = q.compose("EVI")
    assert set(late.scenes.columns) >= {"blue", "red", "nir"} and late.scenes.where("blue is not null").count() == 4
    with pytest.raises(ValueError, match="has no"):
        q.compose("nothing")
    out = q.as_time_series()
    assert out.schema["value"].metadata["index"] == "NDVI" and out.count() == 2
    assert q.kept(f"file://{tmp_path}/kept").as_raster().count() == 4
    with pytest.raises(ValueError, match="needs the columns"):
        retrieve(q.scenes.drop("r"), q.seeds, 2, 2, "2021-01-01", "2021-02-01", "NDVI")


def test_polygon_masks_keep_touched_cells_and_views_crop(spark):
    px, seeds = field(spark)
    q = retrieve(px, seeds.drop("rmax"), 21, 21, "2021-01-01", "2021-01-31")
    assert q.seeds.first().rmax == 10
    edges = spark.createDataFrame([("a", *e[2:]) for e in squares((0, 0, 4.5, 4.5, 6.5, 6.5))], "site_id string, x1 double, y1 double, x2 double, y2 double")
    kept = q.as_raster(mask=edges).where("v is not null")
    assert {(r.r, r.c) for r in kept.collect()} == {(r, c) for r in (5, 6, 7) for c in (5, 6, 7)}
    with pytest.raises(ValueError, match="empty"):
        q.as_raster(mask=edges.limit(0))
    whole = spark.createDataFrame([("a", 32750, 21, 21, 0.0, 210.0, 10.0, 10.0)], "site_id string, epsg int, nrow int, ncol int, xmin double, ymax double, res_x double, res_y double")
    box = whole.select("site_id", F.struct(F.lit(15.0).alias("xmin"), F.lit(150.0).alias("ymin"), F.lit(40.0).alias("xmax"), F.lit(181.0).alias("ymax")).alias("box"))
    from dataclasses import replace

    seen = replace(q, grids=whole, view=box).as_raster().collect()
    assert {(r.r, r.c) for r in seen} == {(r, c) for r in range(3, 7) for c in range(2, 5)}


def test_labels_and_identities(spark, tmp_path):
    from fieldloom.operators import cache
    from fieldloom.sources import catalogue as sources

    assert cache.safe_label("https://me:secret@host/a/b.parquet?sig=1#x") == "https://host/a/b.parquet" and cache.safe_label("/a/b") == "/a/b"
    path = f"file://{tmp_path}/t"
    spark.createDataFrame([("a", 1, 2, 3.0, 4.0)], "site_id string, r int, c int, nir double, red double").withColumn("scene_date", F.to_date(F.lit("2021-01-05"))).write.parquet(path)
    one = cache.source_id(spark, path)
    assert one == cache.source_id(spark, path)
    own = sources.pixels(spark, path, ["nir"], "2021-01-01", "2021-01-31")
    assert own.columns == ["site_id", "scene_date", "r", "c", "nir"] and own.count() == 1 and "red" not in own._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="blue"):
        sources.pixels(spark, path, ["blue"])
    spark.read.parquet(path).coalesce(1).write.mode("append").parquet(path)
    assert cache.source_id(spark, path) != one
    with pytest.raises(FileNotFoundError, match="gone"):
        cache.source_id(spark, f"file://{tmp_path}/gone?sig=1".replace("?sig=1", ""))
    assert sources.signed_text("a?b", "t") == "a?b&t" and sources.signed_text("a", "t") == "a?t" and sources.signed_text("a", None) == "a"


def test_median_of_large_scenes(spark):
    from fieldloom.operators import series

    px = spark.range(20_001).select(F.lit(1).alias("site_id"), F.to_date(F.lit("2021-01-05")).alias("scene_date"), (F.col("id") / 20_000).alias("v"))
    exact, close = (series.scene_values(px, "v", how).first()["value"] for how in ("median", "median_approx"))
    assert exact == 0.5 and abs(close - 0.5) < 2e-4


SITES = [("a", 117.1, -32.0, "2021-01-01", "2021-02-01"), ("b", 117.2, -32.0, "2021-01-01", "2021-02-01"), ("c", 500.0, 0.0, "2021-01-01", "2021-02-01"), ("d", 117.3, -32.0, "2021-01-01", "2021-02-01")]


def test_rounds_and_cache(spark, tmp_path):
    sites = spark.createDataFrame(SITES, "id string, longitude double, latitude double, start_date string, end_date string")
    turns, waits = [], []

    def attempt(pending, turn):
        turns.append(sorted(r.id for r in pending.collect()))
        errors = pending.where((F.col("id") == "b") & F.lit(turn == 1)).select("id", F.lit("HTTP 503 at https://x/y?token=1").alias("reason"), F.lit(True).alias("retryable"))
        return pending.where("id != 'd'").select("id", F.lit("2021-01-05").alias("date"), F.lit(0.5).alias("value")), errors

    cache = batch.SiteCache(spark, f"file://{tmp_path}/cache")
    rows, failures, outcomes = batch.rounds(sites, "NDVI", attempt, f"file://{tmp_path}/work", cache=cache, sleep=waits.append)
    assert turns == [["a", "b", "d"], ["b"]] and waits == [2.0]
    assert sorted((r.id, r.value) for r in rows.collect()) == [("a", 0.5), ("b", 0.5)]
    assert {r.id: (r.status, r.dates, r.attempts, r.cached) for r in outcomes.collect()} == {"a": ("success", 1, 1, False), "b": ("success", 1, 2, False), "c": ("failure", 0, 0, False), "d": ("empty", 0, 1, False)}
    assert [(r.id, r["index"], r.reason, r.attempts) for r in failures.collect()] == [("c", "NDVI", "longitude", 0)]
    turns.clear()
    rows, _, outcomes = batch.rounds(sites, "NDVI", attempt, f"file://{tmp_path}/work", cache=cache, sleep=waits.append)
    assert turns == [[]] and rows.count() == 2 and all(r.cached and r.attempts == 0 for r in outcomes.where("id != 'c'").collect())


def test_rounds_stop_and_give_up(spark, tmp_path):
    sites = spark.createDataFrame(SITES[:2], "id string, longitude double, latitude double, start_date string, end_date string")
    none = "id string, date string, value double"

    def attempt(pending, turn):
        return spark.createDataFrame([], none), pending.where("id = 'a'").select("id", F.lit("timed out, see http://h/p?key=2").alias("reason"), F.lit(True).alias("retryable"))

    _, failures, outcomes = batch.rounds(sites, "NDVI", attempt, f"file://{tmp_path}", retries=2, sleep=lambda s: None)
    assert failures.first().asDict() == {"id": "a", "index": "NDVI", "reason": "timed out, see http://h/p", "attempts": 2, "last_error": "timed out, see http://h/p"}
    assert {r.id: (r.status, r.attempts) for r in outcomes.collect()} == {"a": ("failure", 2), "b": ("empty", 1)}
    with pytest.raises(RuntimeError, match="a / NDVI"):
        batch.rounds(sites, "NDVI", attempt, f"file://{tmp_path}", retries=1, on_error="stop")


def test_calibration_is_tried_once_in_a_call():
    tries = []

    def fails():
        tries.append(1)
        raise ValueError("no support")

    outer = Invocation()
    with outer:
        with Invocation.begin(outer) as inner:
            assert inner is outer and inner.calibrated("k", fails, "before") == "before"
        assert outer.calibrated("k", fails, "before") == "before" and len(tries) == 1
        assert outer.calibrated("m", lambda: 7) == 7 and outer.calibrated("m", fails) == 7
    assert outer.calibrated("k", fails) is None and len(tries) == 2
    assert snapshot(index="NDVI", strictness="tight") == snapshot(strictness="tight", index="NDVI") != snapshot(index="NDVI", strictness="loose")


def test_sql_functions_stay_in_the_plan(spark):
    px = spark.createDataFrame([(0.4, 0.1), (0.0, 0.0)], "nir double, red double")
    sql.register(spark, {"fl_px": px}, ["NDVI"])
    out = spark.sql("SELECT fl_ndvi(red, nir) AS v FROM fl_px")
    assert [r.v for r in out.collect()] == [pytest.approx(0.6), None]
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    days = [(r.w, str(r.opens), str(r.closes)) for r in spark.sql("SELECT * FROM fl_windows(DATE '2021-01-01', DATE '2021-01-31', 2) ORDER BY w").collect()]
    assert days == [(1, "2021-01-01", "2021-01-15"), (2, "2021-01-16", "2021-01-31")]
