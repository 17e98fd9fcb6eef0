"""Field polygons: point in polygon, rasterised masks, agreement, strength of a prior.

Polygons are rows of edges (poly_id, x1, y1, x2, y2) in the grid's coordinates.  A point is inside if a ray to the right
crosses an odd number of edges; boxes prune the join.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _crosses(x: Column, y: Column) -> Column:
    spans = (F.col("y1") > y) != (F.col("y2") > y)
    at = F.col("x1") + F.try_divide((y - F.col("y1")) * (F.col("x2") - F.col("x1")), F.col("y2") - F.col("y1"))
    return F.when(spans & (x < at), 1).otherwise(0)


def areas(edges: DataFrame) -> DataFrame:
    """(poly_id, area, xmin, xmax, ymin, ymax) by the shoelace sum."""
    twice = F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))
    return edges.groupBy("poly_id").agg((F.abs(twice) / 2).alias("area"), F.min("x1").alias("xmin"), F.max("x1").alias("xmax"), F.min("y1").alias("ymin"), F.max("y1").alias("ymax"))


def rasterised(edges: DataFrame, size: int) -> DataFrame:
    """(site_id, poly_id, r, c) of cells (row 1 at the lowest y) whose centre is inside.

    An edge is spread only over the rows it spans and counted by scan line: rows out are bounded by the polygon's height
    times its edges, then by its cells.
    """
    rows = edges.where("y1 != y2").withColumn("r", F.explode(F.sequence(F.greatest(F.lit(1), F.floor(F.least("y1", "y2") + 0.5).cast("int")), F.least(F.lit(size), F.ceil(F.greatest("y1", "y2") + 0.5).cast("int")))))
    y = F.col("r") - 0.5
    spans = (F.col("y1") > y) != (F.col("y2") > y)
    at = F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    hits = rows.where(spans).groupBy("site_id", "poly_id", "r").agg(F.sort_array(F.collect_list(at)).alias("xs"))
    spans_in_row = F.filter(F.transform("xs", lambda x, i: F.when(i % 2 == 0, F.struct(x.alias("a"), F.get("xs", i + 1).alias("b")))), lambda s: s.isNotNull())
    runs = hits.select("site_id", "poly_id", "r", F.explode(spans_in_row).alias("s"))
    first, last = F.greatest(F.lit(1), F.ceil(F.col("s.a") + 0.5).cast("int")), F.least(F.lit(size), F.ceil(F.col("s.b") + 0.5).cast("int") - 1)
    return runs.withColumns({"_a": first, "_b": last}).where("_a <= _b").select("site_id", "poly_id", "r", F.explode(F.sequence("_a", "_b")).alias("c"))


def selected(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(site_id, poly_id): the smallest polygon of the site that holds its point (x, y)."""
    near = points.join(edges, "site_id").where(F.col("x").isNotNull())
    area = F.abs(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))) / 2
    sized = near.groupBy("site_id", "poly_id").agg(F.sum(_crosses(F.col("x"), F.col("y"))).alias("_n"), area.alias("area")).where("_n % 2 = 1")
    best = Window.partitionBy("site_id").orderBy("area", "poly_id")
    return sized.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").select("site_id", "poly_id")


def overlap(predicted: DataFrame, reference: DataFrame, keys: list[str], cell: list[str]) -> DataFrame:
    """iou, f1, precision, recall and counts of two cell sets by ``keys``; NULL where a denominator is 0.  One aggregation, no join."""
    tagged = predicted.select(*keys, *cell, F.lit(1).alias("_p"), F.lit(0).alias("_q")).unionByName(reference.select(*keys, *cell, F.lit(0).alias("_p"), F.lit(1).alias("_q")))
    each = tagged.groupBy(*keys, *cell).agg(F.max("_p").alias("_p"), F.max("_q").alias("_q"))
    out = each.groupBy(*keys).agg(F.sum("_p").alias("n_pred"), F.sum("_q").alias("n_ref"), F.sum(F.col("_p") * F.col("_q")).alias("n_intersection"), F.count(F.lit(1)).alias("n_union"))
    both = F.col("n_intersection")
    return out.select(*keys, F.try_divide(both, F.col("n_union")).alias("iou"), F.try_divide(2 * both, F.col("n_pred") + F.col("n_ref")).alias("f1"), F.try_divide(both, F.col("n_pred")).alias("precision"), F.try_divide(both, F.col("n_ref")).alias("recall"), "n_pred", "n_ref", "n_intersection", "n_union")


def prior_strength(scene_year: Column, source_year: Column) -> Column:
    """0.35 halved for every five years between polygon and scenes; 0 without a year."""
    return F.coalesce(F.lit(0.35) * F.pow(F.lit(0.5), F.abs(scene_year - source_year) / 5), F.lit(0.0))


def eroded(cells: DataFrame, keys: list[str], pixels: int = 1) -> DataFrame:
    """Cells whose whole square of ``pixels`` around them is inside; a polygon that would vanish stays as it is.

    A cell votes for the cells around it, so the join is a sum with a fixed number of rows for each cell.
    """
    steps = F.sequence(F.lit(-pixels), F.lit(pixels))
    votes = cells.select(*keys, "r", "c", F.explode(steps).alias("_i")).select("*", F.explode(steps).alias("_j"))
    counted = votes.groupBy(*keys, (F.col("r") + F.col("_i")).alias("r"), (F.col("c") + F.col("_j")).alias("c")).agg(F.count(F.lit(1)).alias("_n"))
    inner = counted.where(F.col("_n") == (2 * pixels + 1) ** 2).select(*keys, "r", "c")
    gone = cells.join(inner.select(*keys).distinct(), keys, "left_anti").select(*keys, "r", "c")
    return inner.unionByName(gone)


def outlines(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x1, y1, x2, y2): the border of a mask as unit edges with the cells on their left; edges that two cells share cancel."""
    x, y = F.col("c") - 1, F.col("r") - 1
    corners = [((0, 0), (1, 0)), ((1, 0), (1, 1)), ((1, 1), (0, 1)), ((0, 1), (0, 0))]
    own = F.array(*(F.struct((x + a).alias("x1"), (y + b).alias("y1"), (x + c).alias("x2"), (y + d).alias("y2")) for (a, b), (c, d) in corners))
    each = cells.select(*keys, F.explode(own).alias("e")).select(*keys, "e.*")
    line = [F.least("x1", "x2").alias("_x"), F.least("y1", "y2").alias("_y"), (F.col("x1") == F.col("x2")).alias("_up")]
    alone = each.groupBy(*keys, *line).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct("x1", "y1", "x2", "y2")).alias("e")).where("_n = 1")
    return alone.select(*keys, "e.*")


def prior(points: DataFrame, edges: DataFrame, size: int, scene_year: int, erode: int = 0) -> DataFrame:
    """(site_id, r, c, strength): cells of each site's polygon, the smallest that holds its point."""
    own = selected(points, edges)
    cells = rasterised(edges.join(own, ["site_id", "poly_id"], "left_semi"), size)
    if erode:
        cells = eroded(cells, ["site_id", "poly_id"], erode)
    years = edges.groupBy("poly_id").agg(F.max("source_year").alias("_year"))
    return cells.join(years, "poly_id").select("site_id", "r", "c", prior_strength(F.lit(scene_year), F.col("_year")).alias("strength"))


def touched(edges: DataFrame, size: int) -> DataFrame:
    """(site_id, poly_id, r, c) of cells that a polygon touches: those whose centre is inside and those that an edge crosses.

    An edge is spread over the rows it spans, and in each over the columns between where it enters and leaves.  A border
    that only runs along a cell's side doesn't touch the cell.
    """
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    last = F.greatest(F.ceil(high).cast("int"), F.floor(low).cast("int") + 1)
    rows = edges.withColumn("r", F.explode(F.sequence(F.floor(low).cast("int") + 1, last)))
    # x where the edge enters and leaves the row's band
    at = lambda y: F.when(F.col("y1") == F.col("y2"), F.col("x1")).otherwise(F.col("x1") + (y - F.col("y1")) * F.try_divide(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    level = F.col("y1") == F.col("y2")
    a = F.when(level, F.col("x1")).otherwise(at(F.greatest(low, (F.col("r") - 1).cast("double"))))
    b = F.when(level, F.col("x2")).otherwise(at(F.least(high, F.col("r").cast("double"))))
    spans = rows.withColumns({"_x1": F.least(a, b), "_x2": F.greatest(a, b)})
    # along a side of cells: neither row (column) is entered
    spans = spans.where(~(level & (F.col("y1") == F.floor("y1"))) & ~((F.col("x1") == F.col("x2")) & (F.col("x1") == F.floor("x1"))))
    first, final = F.greatest(F.lit(1), F.floor("_x1").cast("int") + 1), F.least(F.lit(size), F.greatest(F.ceil("_x2").cast("int"), F.floor("_x1").cast("int") + 1))
    hit = spans.withColumns({"_a": first, "_b": final}).where((F.col("_a") <= F.col("_b")) & F.col("r").between(1, size)).select("site_id", "poly_id", "r", F.explode(F.sequence("_a", "_b")).alias("c"))
    return rasterised(edges, size).unionByName(hit).distinct()


def dissolved(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The border of all areas of ``keys`` together: borders between areas vanish."""
    return outlines(cells.select(*keys, "r", "c").distinct(), keys)


def measured(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, area, length) of outlines, by the shoelace sum."""
    twice = F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))
    length = F.sum(F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2)))
    return edges.groupBy(*keys).agg((F.abs(twice) / 2).cast("double").alias("area"), length.alias("length"))


def shrunk(edges: DataFrame, size: int, distance: float) -> DataFrame:
    """(site_id, poly_id, r, c) of cells whose centre is inside and at least ``distance`` from every edge (a negative buffer).

    A cell meets only the edges of its own polygon.
    """
    cells = rasterised(edges, size)
    own = cells.join(edges.select("site_id", "poly_id", "x1", "y1", "x2", "y2"), ["site_id", "poly_id"])
    x, y = F.col("c") - 0.5, F.col("r") - 0.5
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    along = F.coalesce(F.try_divide((x - F.col("x1")) * dx + (y - F.col("y1")) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    away = F.pow(x - F.col("x1") - t * dx, 2) + F.pow(y - F.col("y1") - t * dy, 2)
    near = own.groupBy("site_id", "poly_id", "r", "c").agg(F.min(away).alias("_d"))
    return near.where(F.col("_d") >= distance * distance).drop("_d")


def of_points(points: DataFrame, edges: DataFrame, size: float = 8.0) -> DataFrame:
    """``edges`` with site_id: the polygons whose box holds a site's point (site_id, x, y).

    Polygons are dealt to the squares of ``size`` that their boxes touch and a point to the one it lies in, so the join has
    an equality and no pair outside a square is made.
    """
    boxes = areas(edges).select("poly_id", "xmin", "xmax", "ymin", "ymax")
    square = lambda v: F.floor(v / size).cast("int")
    dealt = boxes.withColumn("_tx", F.explode(F.sequence(square(F.col("xmin")), square(F.col("xmax"))))).withColumn("_ty", F.explode(F.sequence(square(F.col("ymin")), square(F.col("ymax")))))
    placed = points.where("x is not null and y is not null").withColumns({"_tx": square(F.col("x")), "_ty": square(F.col("y"))})
    near = placed.join(dealt, ["_tx", "_ty"]).where(F.col("x").between(F.col("xmin"), F.col("xmax")) & F.col("y").between(F.col("ymin"), F.col("ymax")))
    return edges.drop("site_id").join(near.select("site_id", "poly_id"), "poly_id")


def ring_texts(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ring, wkt): closed rings of outlines made by ``outlines``, as POLYGON text, each from its lowest corner on.

    A group's edges are one area's border; they are chained in one call for each group.  Where four edges meet, the ring
    turns left, so areas that touch by a corner keep rings of their own.
    """
    kinds = ", ".join(f"{k} {edges.schema[k].dataType.simpleString()}" for k in keys)

    def chained(own: pd.DataFrame) -> pd.DataFrame:
        leaving: dict[tuple, list[tuple]] = {}
        for e in own[["x1", "y1", "x2", "y2"]].itertuples(index=False):
            leaving.setdefault((e.x1, e.y1), []).append((e.x2, e.y2))
        rings = []
        for start in sorted(leaving, key=lambda p: (p[1], p[0])):
            while leaving.get(start):
                ring, at, way = [start], start, None
                while True:
                    options = leaving[at]
                    if way is None or len(options) == 1:
                        to = options.pop()
                    else:
                        turn = lambda p: (way[0] * (p[1] - at[1]) - way[1] * (p[0] - at[0]))  # noqa: B023, E731
                        to = max(options, key=turn)
                        options.remove(to)
                    step = (to[0] - at[0], to[1] - at[1])
                    if step == way:
                        ring[-1] = to
                    else:
                        ring.append(to)
                    at, way = to, step
                    if at == start:
                        break
                rings.append("POLYGON ((" + ", ".join(f"{x:g} {y:g}" for x, y in ring) + "))")
        out = pd.DataFrame({"ring": range(1, len(rings) + 1), "wkt": rings})
        for i, k in enumerate(keys):
            out.insert(i, k, [own[k].iloc[0]] * len(out))
        return out

    return edges.groupBy(*keys).applyInPandas(chained, f"{kinds}, ring int, wkt string")


def box_edges(boxes: DataFrame) -> DataFrame:
    """(site_id, x1, y1, x2, y2): the border of each site's box (xmin, ymin, xmax, ymax) as edges, counter-clockwise."""
    a, b, c, d = (F.col(f"box.{k}") for k in ("xmin", "ymin", "xmax", "ymax"))
    ring = [((a, b), (c, b)), ((c, b), (c, d)), ((c, d), (a, d)), ((a, d), (a, b))]
    edges = F.array(*(F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")) for (x1, y1), (x2, y2) in ring))
    return boxes.select("site_id", F.inline(edges))


def check_mask(mask: DataFrame) -> DataFrame:
    """A mask of cells that an output may use; an error for one without the columns of cells or without cells."""
    missing = [c for c in ("site_id", "r", "c") if c not in mask.columns]
    if missing:
        raise ValueError(f"a mask needs the columns {', '.join(missing)}")
    if mask.isEmpty():
        raise ValueError("the mask is empty")
    return mask
