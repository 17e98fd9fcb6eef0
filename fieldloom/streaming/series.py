"""Zonal series over a stream of pixels: the batch operator's first level with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_series(pixels: DataFrame, value: str, instant: str = "instant", late: str = "3 days", every: str = "1 day") -> DataFrame:
    """(site_id, start, value, n): the mean of each site and window; a window closes when the watermark passes it."""
    watched = pixels.withWatermark(instant, late)
    grouped = watched.groupBy("site_id", F.window(instant, every).alias("_w")).agg(F.avg(value).alias("value"), F.count(value).alias("n"))
    return grouped.select("site_id", F.col("_w.start").alias("start"), "value", "n")
