"""Mosaics, alignment, temporal composites and detection features over rows of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REDUCERS = {"median": F.median, "mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum}


def mosaic(pixels: DataFrame, keys: list[str], bands: list[str], order: str) -> DataFrame:
    """One value for each key and band: the first tile (by ``order``) that has one.  A partial aggregate, no sort."""
    return pixels.groupBy(*keys).agg(*(F.min_by(b, F.when(F.col(b).isNotNull(), F.col(order))).alias(b) for b in bands))


def complete_dates(pixels: DataFrame, keys: list[str], bands: list[str]) -> DataFrame:
    """Rows of the groups in which every band has a value somewhere."""
    has = pixels.groupBy(*keys).agg(*(F.count(b).alias(f"_{b}") for b in bands))
    for b in bands:
        has = has.where(F.col(f"_{b}") > 0)
    return pixels.join(has.select(*keys), keys, "left_semi")


def refined(coarse: DataFrame, value: str, factor: int, keys: list[str]) -> DataFrame:
    """Bilinear values on a grid ``factor`` times finer with the same origin; weights are renormalised over cells with a value.

    Every coarse cell is spread over the fine cells it can weigh on (at most ``(2 * factor)**2`` rows, whatever the
    raster's size) and summed by fine cell: one shuffle with partial sums, no self-join.
    """
    steps = F.sequence(F.lit(1 - factor // 2 - factor), F.lit(factor + (factor + 1) // 2))
    fine = coarse.where(F.col(value).isNotNull()).select(*keys, "r", "c", value, F.explode(steps).alias("_i"))
    fine = fine.select("*", F.explode(steps).alias("_j"))
    at = lambda cell, step: (F.col(cell) - 1) * factor + F.col(step)
    centre = lambda cell: (F.col(cell) - 0.5) * factor + 0.5
    weight = lambda cell, step: F.greatest(F.lit(0.0), 1 - F.abs(at(cell, step) - centre(cell)) / factor)
    spread = fine.select(*keys, at("r", "_i").alias("r"), at("c", "_j").alias("c"), value, (weight("r", "_i") * weight("c", "_j")).alias("_w")).where("_w > 0")
    return spread.groupBy(*keys, "r", "c").agg((F.sum(F.col(value) * F.col("_w")) / F.sum("_w")).alias(value))


def composite(pixels: DataFrame, value: str, how: str = "median", keys: tuple[str, ...] = ("site_id", "r", "c")) -> DataFrame:
    """A statistic of each cell over time; a cell without a value stays NULL, for sums too."""
    if how not in REDUCERS:
        raise ValueError(f"unknown composite {how!r}; known: {', '.join(REDUCERS)}")
    return pixels.groupBy(*keys).agg(REDUCERS[how](value).alias(value))


def masked(raster: DataFrame, mask: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Cells outside the mask lose their value; an empty mask empties the raster."""
    inside = mask.select(*keys).distinct().withColumn("_in", F.lit(True))
    return raster.join(inside, keys, "left").withColumn(value, F.when(F.col("_in"), F.col(value))).drop("_in")


def area_layers(raster: DataFrame, mask: DataFrame, value: str, keys: list[str], areas: list[int]) -> DataFrame:
    """Layers area_1 to area_n and union: one left join with the mask pivoted by area (a fixed list, so no extra job)."""
    flags = mask.groupBy(*keys).agg(*(F.max(F.col("area_num") == a).alias(f"_{a}") for a in areas))
    out = raster.join(flags, keys, "left")
    inside = F.lit(False)
    for a in areas:
        inside = inside | F.coalesce(F.col(f"_{a}"), F.lit(False))
    layers = {f"area_{a}": F.when(F.col(f"_{a}"), F.col(value)) for a in areas} | {"union": F.when(inside, F.col(value))}
    return out.select(*keys, *(v.alias(k) for k, v in layers.items()))


def window_number(day: Column, start: str, end: str, windows: int) -> Column:
    """Equal parts of a period, half open but for the last; NULL outside."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    number = F.least(F.lit(windows), F.floor(F.datediff(day, first) * windows / F.datediff(last, first)).cast("int") + 1)
    return F.when(day.between(first, last), number)


def window_count(days: int, resolution: int) -> int:
    return min(3, days // (2 * resolution) + 1)


def window_features(pixels: DataFrame, value: str, start: str, end: str, windows: int = 3) -> DataFrame:
    """(site_id, r, c, w1..wn): the largest value of each cell in each window, in one aggregation."""
    numbered = pixels.withColumn("_w", window_number(F.col("scene_date"), start, end, windows)).where("_w is not null")
    return numbered.groupBy("site_id", "r", "c").agg(*(F.max(F.when(F.col("_w") == k, F.col(value))).alias(f"w{k}") for k in range(1, windows + 1)))


def empty_windows(pixels: DataFrame, value: str, start: str, end: str, windows: int, keys: tuple[str, ...] = ("site_id",)) -> DataFrame:
    """(keys, w) of windows without any value."""
    numbered = pixels.select(*keys, window_number(F.col("scene_date"), start, end, windows).alias("w"), value)
    seen = numbered.groupBy(*keys).agg(F.collect_set(F.when(F.col(value).isNotNull(), F.col("w"))).alias("_seen"))
    return seen.select(*keys, F.explode(F.array_except(F.sequence(F.lit(1), F.lit(windows)), "_seen")).alias("w"))
