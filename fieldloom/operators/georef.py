"""Georeferenced grids: cells and coordinates, extents, crops, merged grids and reprojection as column arithmetic and joins.

A grid is a row (site_id, epsg, nrow, ncol, xmin, ymax, res_x, res_y); rows count from 1 at the north, columns from 1 at
the west, cell numbers from 1 along the rows.  Values are rows of cells (keys, r, c, value columns).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo

GRID = ("epsg", "nrow", "ncol", "xmin", "ymax", "res_x", "res_y")


def extent() -> Column:
    """struct<xmin,xmax,ymin,ymax> of a grid row."""
    return F.struct(F.col("xmin"), (F.col("xmin") + F.col("ncol") * F.col("res_x")).alias("xmax"), (F.col("ymax") - F.col("nrow") * F.col("res_y")).alias("ymin"), F.col("ymax"))


def centre(r: Column, c: Column) -> tuple[Column, Column]:
    """Coordinates of a cell's centre in its grid row."""
    return F.col("xmin") + (c - 0.5) * F.col("res_x"), F.col("ymax") - (r - 0.5) * F.col("res_y")


def cell_of_xy(x: Column, y: Column) -> tuple[Column, Column]:
    """(row, column) of a point in its grid row; a point on the far edge is in the last cell, one outside in none."""
    r = F.floor((F.col("ymax") - y) / F.col("res_y")) + 1
    c = F.floor((x - F.col("xmin")) / F.col("res_x")) + 1
    last_r = F.when(y == F.col("ymax") - F.col("nrow") * F.col("res_y"), F.col("nrow")).otherwise(r)
    last_c = F.when(x == F.col("xmin") + F.col("ncol") * F.col("res_x"), F.col("ncol")).otherwise(c)
    inside = last_r.between(1, F.col("nrow")) & last_c.between(1, F.col("ncol"))
    return F.when(inside, last_r).cast("int"), F.when(inside, last_c).cast("int")


def cell_number(r: Column, c: Column) -> Column:
    """Number of a cell along the rows; NULL outside the grid."""
    return F.when(r.between(1, F.col("nrow")) & c.between(1, F.col("ncol")), (r.cast("long") - 1) * F.col("ncol") + c)


def row_of(cell: Column) -> Column:
    return F.when(cell.between(1, F.col("nrow").cast("long") * F.col("ncol")), F.floor((cell - 1) / F.col("ncol")) + 1).cast("int")


def column_of(cell: Column) -> Column:
    return F.when(cell.between(1, F.col("nrow").cast("long") * F.col("ncol")), (cell - 1) % F.col("ncol") + 1).cast("int")


def seed_limit(r: Column, c: Column) -> Column:
    """The largest complete square around a cell: its distance to the nearest grid edge; NULL outside."""
    inside = r.between(1, F.col("nrow")) & c.between(1, F.col("ncol"))
    return F.when(inside, F.least(r - 1, F.col("nrow") - r, c - 1, F.col("ncol") - c)).cast("int")


def seeds(points: DataFrame, grids: DataFrame) -> DataFrame:
    """(site_id, r0, c0, rmax): the cell that holds a site's point (x, y in the grid's coordinates) and its limit.

    A point outside its grid gives NULLs, which ``checked_seeds`` turns into an error.
    """
    r, c = cell_of_xy(F.col("x"), F.col("y"))
    placed = points.select("site_id", "x", "y").join(grids, "site_id").withColumns({"r0": r, "c0": c})
    return placed.select("site_id", "r0", "c0", seed_limit(F.col("r0"), F.col("c0")).alias("rmax"))


def checked_seeds(found: DataFrame) -> DataFrame:
    """``found`` with an error, at run time, for a point outside its grid."""
    message = F.concat(F.lit("the point of site "), F.col("site_id").cast("string"), F.lit(" is outside its grid"))
    return found.withColumn("r0", F.coalesce("r0", F.raise_error(message).cast("int")))


def same_geometry(left: str, right: str, tolerance: float = 1e-6) -> Column:
    """Whether two struct columns hold one grid: system, dimensions, cell size and origin, the last two within a part of a cell."""
    equal = F.lit(True)
    for name in ("epsg", "nrow", "ncol"):
        equal = equal & F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    for name, unit in (("res_x", "res_x"), ("res_y", "res_y"), ("xmin", "res_x"), ("ymax", "res_y")):
        equal = equal & (F.abs(F.col(f"{left}.{name}") - F.col(f"{right}.{name}")) <= F.lit(tolerance) * F.col(f"{left}.{unit}"))
    return F.coalesce(equal, F.lit(False))


def window_of(box: str = "box") -> Column:
    """struct<r1,r2,c1,c2>: rows and columns that a box (xmin, ymin, xmax, ymax) touches, snapped outward and clamped; NULL without overlap."""
    x1, x2 = F.col(f"{box}.xmin"), F.col(f"{box}.xmax")
    y1, y2 = F.col(f"{box}.ymin"), F.col(f"{box}.ymax")
    e = extent()
    overlap = (x1 < e["xmax"]) & (x2 > F.col("xmin")) & (y1 < F.col("ymax")) & (y2 > e["ymin"])
    r1, r2 = F.floor((F.col("ymax") - y2) / F.col("res_y")) + 1, F.ceil((F.col("ymax") - y1) / F.col("res_y"))
    c1, c2 = F.floor((x1 - F.col("xmin")) / F.col("res_x")) + 1, F.ceil((x2 - F.col("xmin")) / F.col("res_x"))
    whole = F.struct(
        F.greatest(r1, F.lit(1)).cast("int").alias("r1"), F.least(r2, F.col("nrow")).cast("int").alias("r2"),
        F.greatest(c1, F.lit(1)).cast("int").alias("c1"), F.least(c2, F.col("ncol")).cast("int").alias("c2"),
    )
    return F.when(overlap, whole)


def cropped(cells: DataFrame, grids: DataFrame, boxes: DataFrame) -> DataFrame:
    """``cells`` (site_id, r, c, ...) inside each site's box, snapped outward.  Cells keep their place in the grid; a site whose
    box misses its grid gives none."""
    windows = grids.join(boxes.select("site_id", "box"), "site_id").select("site_id", window_of().alias("_w")).where("_w is not null")
    inside = F.col("r").between(F.col("_w.r1"), F.col("_w.r2")) & F.col("c").between(F.col("_w.c1"), F.col("_w.c2"))
    return cells.join(windows, "site_id").where(inside).drop("_w")


def cropped_grid(grids: DataFrame, boxes: DataFrame) -> DataFrame:
    """The grids that ``cropped`` cells span."""
    own = grids.join(boxes.select("site_id", "box"), "site_id").withColumn("_w", window_of()).where("_w is not null")
    moved = {"xmin": F.col("xmin") + (F.col("_w.c1") - 1) * F.col("res_x"), "ymax": F.col("ymax") - (F.col("_w.r1") - 1) * F.col("res_y"), "nrow": F.col("_w.r2") - F.col("_w.r1") + 1, "ncol": F.col("_w.c2") - F.col("_w.c1") + 1}
    return own.withColumns(moved).select("site_id", *GRID)


def renumbered(cells: DataFrame, grids: DataFrame, boxes: DataFrame) -> DataFrame:
    """``cropped`` cells with the rows and columns of ``cropped_grid``."""
    windows = grids.join(boxes.select("site_id", "box"), "site_id").select("site_id", window_of().alias("_w")).where("_w is not null")
    inside = F.col("r").between(F.col("_w.r1"), F.col("_w.r2")) & F.col("c").between(F.col("_w.c1"), F.col("_w.c2"))
    return cells.join(windows, "site_id").where(inside).withColumns({"r": F.col("r") - F.col("_w.r1") + 1, "c": F.col("c") - F.col("_w.c1") + 1}).drop("_w")


def moved_boxes(boxes: DataFrame, grids: DataFrame) -> DataFrame:
    """(site_id, box): boxes (site_id, epsg, box) in the system of their site's grid: what their four corners span there."""
    corners = F.explode(F.array(*(F.struct(F.col(f"box.{a}").alias("x"), F.col(f"box.{b}").alias("y")) for a in ("xmin", "xmax") for b in ("ymin", "ymax"))))
    own = boxes.select("site_id", "epsg", corners.alias("p")).join(grids.select("site_id", F.col("epsg").alias("_own")), "site_id")
    own = geo.with_lonlat(own, F.col("p.x"), F.col("p.y"), F.col("epsg"), "_lon", "_lat")
    own = geo.with_xy(own, F.col("_lon"), F.col("_lat"), F.col("_own"), "_x", "_y")
    same = F.col("epsg") == F.col("_own")
    x, y = F.when(same, F.col("p.x")).otherwise(F.col("_x")), F.when(same, F.col("p.y")).otherwise(F.col("_y"))
    return own.groupBy("site_id").agg(F.struct(F.min(x).alias("xmin"), F.min(y).alias("ymin"), F.max(x).alias("xmax"), F.max(y).alias("ymax")).alias("box"))


def trimmed(cells: DataFrame, value: str, keys: tuple[str, ...] = ("site_id",)) -> DataFrame:
    """``cells`` without the empty rows and columns around those that have a value: bounds by one partial aggregate, joined back."""
    bounds = cells.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min("r").alias("_r1"), F.max("r").alias("_r2"), F.min("c").alias("_c1"), F.max("c").alias("_c2"))
    inside = F.col("r").between(F.col("_r1"), F.col("_r2")) & F.col("c").between(F.col("_c1"), F.col("_c2"))
    return cells.join(bounds, list(keys)).where(inside).drop("_r1", "_r2", "_c1", "_c2")


def union_grid(grids: DataFrame, keys: tuple[str, ...] = ("site_id",)) -> DataFrame:
    """The grid that holds all grids of a key, on the origin and cell size of the one that begins furthest west, then north."""
    e = extent()
    first = F.min_by(F.struct("epsg", "xmin", "ymax", "res_x", "res_y"), F.struct("xmin", -F.col("ymax"), "res_x", "res_y"))
    merged = grids.groupBy(*keys).agg(first.alias("g"), F.min("xmin").alias("x1"), F.max(e["xmax"]).alias("x2"), F.min(e["ymin"]).alias("y1"), F.max("ymax").alias("y2"))
    g = lambda name: F.col(f"g.{name}")
    up = F.ceil(F.round((F.col("y2") - g("ymax")) / g("res_y"), 6))  # whole cells north of the first grid's origin
    top = g("ymax") + up * g("res_y")
    return merged.select(
        *keys, g("epsg").alias("epsg"), F.ceil(F.round((top - F.col("y1")) / g("res_y"), 6)).cast("int").alias("nrow"), F.ceil(F.round((F.col("x2") - g("xmin")) / g("res_x"), 6)).cast("int").alias("ncol"),
        g("xmin").alias("xmin"), top.alias("ymax"), g("res_x").alias("res_x"), g("res_y").alias("res_y"),
    )


def cells_of(grids: DataFrame) -> DataFrame:
    """Every cell of every grid with its centre (x, y)."""
    rows = grids.withColumn("r", F.explode(F.sequence(F.lit(1), F.col("nrow"))))
    out = rows.withColumn("c", F.explode(F.sequence(F.lit(1), F.col("ncol"))))
    x, y = centre(F.col("r"), F.col("c"))
    return out.withColumns({"x": x, "y": y})


def projected(cells: DataFrame, values: list[str], source: DataFrame, target: DataFrame, method: str = "bilinear", keys: tuple[str, ...] = ()) -> DataFrame:
    """(site_id, keys, r, c, values) on each site's ``target`` grid.

    A target cell looks up the source cells around its centre: the nearest, or four with bilinear weights, which are
    renormalised over those with a value.  Systems may differ (geographic or UTM); centres go through longitude and
    latitude then.  Target cells are made from the grids and joined by (site_id, r, c), one equi-join for all scenes.
    """
    if method not in ("bilinear", "near"):
        raise ValueError("method is bilinear or near")
    own = cells_of(target.select("site_id", *GRID)).select("site_id", "epsg", "r", "c", "x", "y")
    sides = own.join(source.select("site_id", *(F.col(g).alias(f"s_{g}") for g in GRID)), "site_id")
    sides = geo.with_lonlat(sides, F.col("x"), F.col("y"), F.col("epsg"), "_lon", "_lat")
    sides = geo.with_xy(sides, F.col("_lon"), F.col("_lat"), F.col("s_epsg"), "_tx", "_ty")
    same = F.col("epsg") == F.col("s_epsg")
    sides = sides.withColumns({"_x": F.when(same, F.col("x")).otherwise(F.col("_tx")), "_y": F.when(same, F.col("y")).otherwise(F.col("_ty"))})
    fr, fc = (F.col("s_ymax") - F.col("_y")) / F.col("s_res_y") + 0.5, (F.col("_x") - F.col("s_xmin")) / F.col("s_res_x") + 0.5
    if method == "near":
        near = sides.withColumns({"_r": F.floor(fr + 0.5).cast("int"), "_c": F.floor(fc + 0.5).cast("int")}).select("site_id", "r", "c", "_r", "_c")
        found = cells.select("site_id", *keys, F.col("r").alias("_r"), F.col("c").alias("_c"), *values)
        return near.join(found, ["site_id", "_r", "_c"]).select("site_id", *keys, "r", "c", *values)
    spots = sides.withColumns({"_fr": fr, "_fc": fc}).withColumn("_s", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)))))
    spots = spots.withColumns({"_r": F.floor("_fr").cast("int") + F.col("_s.i"), "_c": F.floor("_fc").cast("int") + F.col("_s.j")})
    weight = (1 - F.abs(F.col("_fr") - F.col("_r"))) * (1 - F.abs(F.col("_fc") - F.col("_c")))
    spots = spots.withColumn("_w", weight).where("_w > 0").select("site_id", "r", "c", "_r", "_c", "_w")
    found = cells.select("site_id", *keys, F.col("r").alias("_r"), F.col("c").alias("_c"), *values)
    joined = spots.join(found, ["site_id", "_r", "_c"])
    mean = lambda v: F.try_divide(F.sum(F.col(v) * F.col("_w")), F.sum(F.when(F.col(v).isNotNull(), F.col("_w"))))
    return joined.groupBy("site_id", *keys, "r", "c").agg(*(mean(v).alias(v) for v in values))


def aligned(cells: DataFrame, values: list[str], source: DataFrame, target: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Cells on the target grids: as they are where the grids agree, reprojected (bilinear) where they don't."""
    both = source.select("site_id", F.struct(*GRID).alias("a")).join(target.select("site_id", F.struct(*GRID).alias("b")), "site_id")
    agree = both.where(same_geometry("a", "b")).select("site_id")
    other = both.join(agree, "site_id", "left_anti").select("site_id")
    kept = cells.join(agree, "site_id", "left_semi").select("site_id", *keys, "r", "c", *values)
    moved = projected(cells.join(other, "site_id", "left_semi"), values, source.join(other, "site_id", "left_semi"), target.join(other, "site_id", "left_semi"), "bilinear", keys)
    return kept.unionByName(moved)


def analysed_box(points: DataFrame, x_metres: Column, y_metres: Column) -> DataFrame:
    """(site_id, epsg, x, y, box): a site's point (lon, lat) in its UTM zone and the box of full width and height around it."""
    own = geo.with_xy(points.withColumn("epsg", geo.utm_epsg(F.col("lon"), F.col("lat"))), F.col("lon"), F.col("lat"), F.col("epsg"))
    box = F.struct((F.col("x") - x_metres / 2).alias("xmin"), (F.col("y") - y_metres / 2).alias("ymin"), (F.col("x") + x_metres / 2).alias("xmax"), (F.col("y") + y_metres / 2).alias("ymax"))
    return own.select("site_id", "epsg", "x", "y", box.alias("box"))


def expanse(cells: DataFrame, grids: DataFrame, keys: tuple[str, ...] = ("site_id",)) -> DataFrame:
    """(keys, area): square metres of cells; on a geographic grid each row's cells have the ellipsoid's area between its parallels."""
    own = cells.join(grids, "site_id")
    north = F.col("ymax") - (F.col("r") - 1) * F.col("res_y")
    lonlat = geo.parallel_area(north) - geo.parallel_area(north - F.col("res_y"))
    one = F.when(F.col("epsg") == 4326, lonlat * F.radians(F.col("res_x"))).otherwise(F.col("res_x") * F.col("res_y"))
    return own.groupBy(*keys).agg(F.sum(one).alias("area"))
