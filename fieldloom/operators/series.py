"""Zonal time series."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .raster import REDUCERS

#: ``median`` keeps every distinct value of a scene in one place; ``median_approx`` is for scenes of any size: a sketch of
#: 10,000 points, off by a ten-thousandth of the ranks at most.
SCENE_REDUCERS = REDUCERS | {"median_approx": lambda c: F.percentile_approx(c, 0.5, 10_000).cast("double")}

FORMATS = {"daily": "yyyy-MM-dd", "monthly": "yyyy-MM", "yearly": "yyyy"}


def bucket(day: Column, every: str) -> Column:
    if every not in FORMATS:
        raise ValueError(f"unknown bucket {every!r}; known: {', '.join(FORMATS)}")
    return F.date_format(day, FORMATS[every])


def scene_values(pixels: DataFrame, value: str, how: str = "mean", keys: tuple[str, ...] = ("site_id", "scene_date")) -> DataFrame:
    """One statistic for each scene; scenes without a value go."""
    return pixels.groupBy(*keys).agg(SCENE_REDUCERS[how](value).alias("value")).where("value is not null")


def observed_first(scenes: DataFrame) -> DataFrame:
    """On a day with an observation, estimates (is_fused) go."""
    best = Window.partitionBy("site_id", "scene_date").orderBy("is_fused")
    return scenes.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank")


def series(pixels: DataFrame, value: str, every: str = "daily", how: str = "mean") -> DataFrame:
    """(site_id, date, value): the statistic of scene values (not of pooled pixels) in each bucket."""
    scenes = scene_values(pixels, value, how)
    return scenes.groupBy("site_id", bucket(F.col("scene_date"), every).alias("date")).agg(SCENE_REDUCERS[how]("value").alias("value"))


def rolled_up(pixels: DataFrame, value: str, how: str = "mean") -> DataFrame:
    """(site_id, year, month, value, n): scene values by month, year, site and in all, NULLs marking totals; one pass."""
    scenes = scene_values(pixels, value, how).select("site_id", F.year("scene_date").alias("year"), F.month("scene_date").alias("month"), "value")
    return scenes.rollup("site_id", "year", "month").agg(SCENE_REDUCERS[how]("value").alias("value"), F.count(F.lit(1)).alias("n"))


def area_series(pixels: DataFrame, mask: DataFrame, value: str, areas: list[int], every: str = "daily", how: str = "mean") -> DataFrame:
    """(site_id, date, area_1.., union): one pass; a cell counts in its area and in the union."""
    flags = mask.groupBy("site_id", "r", "c").agg(*(F.max(F.col("area_num") == a).alias(f"_{a}") for a in areas))
    own = pixels.join(flags, ["site_id", "r", "c"])
    names = [f"area_{a}" for a in areas] + ["union"]
    parts = [F.when(F.col(f"_{a}"), F.col(value)) for a in areas] + [F.col(value)]
    scenes = own.groupBy("site_id", "scene_date").agg(*(SCENE_REDUCERS[how](p).alias(n) for n, p in zip(names, parts, strict=True)))
    out = scenes.groupBy("site_id", bucket(F.col("scene_date"), every).alias("date")).agg(*(SCENE_REDUCERS[how](n).alias(n) for n in names))
    return out.where(F.coalesce(*names).isNotNull())


def fused_series(pixels: DataFrame, value: str, every: str = "daily", how: str = "mean", mask: DataFrame | None = None, areas: list[int] | None = None) -> DataFrame:
    """(site_id, date, is_fused, value or area_1.., union, anchor_days, anchor_mae, anchor_nmae): on a day with an observation
    estimates go; buckets hold estimates and observations apart.  The anchor's mean residual, alone and against the mean of
    the fine index there, is that of the union of the cells."""
    keys, names, parts = ["site_id", "r", "c"], ["value"], [F.col(value)]
    if areas:
        pixels = pixels.join(mask.groupBy(*keys).agg(*(F.max(F.col("area_num") == a).alias(f"_{a}") for a in areas)), keys)
        names = [f"area_{a}" for a in areas] + ["union"]
        parts = [F.when(F.col(f"_{a}"), F.col(value)) for a in areas] + [F.col(value)]
    elif mask is not None:
        pixels = pixels.join(mask.select(*keys).distinct(), keys, "left_semi")
    scenes = pixels.groupBy("site_id", "scene_date", "is_fused").agg(
        *(SCENE_REDUCERS[how](p).alias(n) for n, p in zip(names, parts, strict=True)),
        F.max("anchor_days").alias("anchor_days"), F.avg("residual").alias("anchor_mae"), F.abs(F.avg("anchor_value")).alias("_fine"),
    ).where(F.coalesce(*names).isNotNull())
    nmae = F.when(F.col("_fine") > 1e-6, F.col("anchor_mae") / F.col("_fine"))
    scenes = observed_first(scenes.withColumn("anchor_nmae", nmae).drop("_fine"))
    date, columns = bucket(F.col("scene_date"), every).alias("date"), [*names, "anchor_days", "anchor_mae", "anchor_nmae"]
    if every == "daily":
        return scenes.select("site_id", date, "is_fused", *columns)
    return scenes.groupBy("site_id", date, "is_fused").agg(*(SCENE_REDUCERS[how](n).alias(n) for n in columns))


def custom_series(pixels: DataFrame, value: str, function: Callable, every: str = "daily") -> DataFrame:
    """The same with any function of an array of finite values, as an Arrow-backed grouped aggregate."""

    @F.pandas_udf("double")
    def apply(x: pd.Series) -> float:
        x = x.dropna()
        return float(function(x.to_numpy())) if len(x) else None

    scenes = pixels.groupBy("site_id", "scene_date").agg(apply(F.col(value)).alias("value")).where("value is not null")
    return scenes.groupBy("site_id", bucket(F.col("scene_date"), every).alias("date")).agg(apply(F.col("value")).alias("value"))
