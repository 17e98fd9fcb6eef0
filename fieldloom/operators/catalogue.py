"""Catalogue operators: choice of sensor, item filters, processing versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.reflectance import sensor

# First days of the sensors.
FIRST_S2, FIRST_L8 = "2015-07-01", "2013-04-01"


def resolved_source(start: Column) -> Column:
    """The sensor of a start date."""
    return F.when(start >= F.lit(FIRST_S2).cast("date"), "sentinel-2").when(start >= F.lit(FIRST_L8).cast("date"), "landsat-8").otherwise("landsat-5")


def check_source(source: str, start: str) -> str:
    """'auto' becomes a sensor; a sensor before its first day is an error (the oldest never is)."""
    if source == "auto":
        return "sentinel-2" if start >= FIRST_S2 else "landsat-8" if start >= FIRST_L8 else "landsat-5"
    sensor(source)
    first = {"sentinel-2": FIRST_S2, "landsat-8": FIRST_L8}.get(source, "")
    if start < first:
        raise ValueError(f"{source} has no scenes before {first}")
    return source


def items(catalogue: DataFrame, start: str, end: str, max_cloud: float | None = None, platforms: tuple[str, ...] | None = None, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Items whose day lies in the period (both ends in), under the cloud limit, of a listed platform, over the box.

    All are plain predicates on the catalogue's columns, so a Parquet catalogue prunes by them.
    """
    out = catalogue.where(F.col("scene_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if max_cloud is not None:
        out = out.where(F.col("cloud") <= max_cloud)
    if platforms is not None:
        out = out.where(F.col("platform").isin(*platforms))
    if box is not None:
        xmin, ymin, xmax, ymax = box
        out = out.where((F.col("xmax") >= xmin) & (F.col("xmin") <= xmax) & (F.col("ymax") >= ymin) & (F.col("ymin") <= ymax))
    return out


def select_processing(items: DataFrame, identity: list[str], order: str = "highest_baseline") -> DataFrame:
    """One item of each acquisition: by baseline, then known and later (or earlier) generation, then id.

    Items with an incomplete identity are never grouped; a group with an unreadable baseline stays whole.
    """
    if order not in ("highest_baseline", "lowest_baseline"):
        raise ValueError("order is highest_baseline or lowest_baseline")
    high = order == "highest_baseline"
    way = (lambda c: F.col(c).desc()) if high else (lambda c: F.col(c).asc())
    complete = F.lit(True)
    for c in identity:
        complete = complete & F.col(c).isNotNull()
    alone = F.when(~complete, F.col("item_id"))
    own = Window.partitionBy(*identity, "_alone")
    ranked = items.withColumn("_alone", alone).withColumn("_open", F.max((F.col("major").isNull() | F.col("minor").isNull()).cast("int")).over(own))
    best = own.orderBy(way("major"), way("minor"), F.col("generation").isNull().asc(), way("generation"), F.col("item_id").asc())
    ranked = ranked.withColumn("_rank", F.row_number().over(best))
    return ranked.where((F.col("_rank") == 1) | (F.col("_open") == 1)).drop("_alone", "_open", "_rank")


def acquisition_instant(text: Column) -> Column:
    """Canonical UTC text of an instant, all fractional digits kept and trailing zeros removed; NULL if impossible."""
    parts = r"^(\d{4}-\d{2}-\d{2})[Tt ](\d{2}:\d{2}:\d{2})(?:\.(\d+))?(?:[Zz]|([+-])(\d{2}):?(\d{2}))$"
    get = lambda k: F.regexp_extract(text, parts, k)
    base = F.try_to_timestamp(F.concat(get(1), F.lit(" "), get(2)), F.lit("yyyy-MM-dd HH:mm:ss"))
    hours, minutes = get(5).try_cast("int"), get(6).try_cast("int")
    shift = F.coalesce((hours * 60 + minutes) * F.when(get(4) == "-", -1).otherwise(1), F.lit(0))
    moved = F.timestamp_add("MINUTE", -shift, base)
    fraction = F.regexp_replace(get(3), "0+$", "")
    out = F.concat(F.date_format(moved, "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(""), F.lit("Z"))
    return F.when(text.rlike(parts) & (F.coalesce(hours, F.lit(0)) <= 23) & (F.coalesce(minutes, F.lit(0)) <= 59), out)


def stripped_query(text: Column) -> Column:
    """URLs without what follows their question mark."""
    return F.regexp_replace(text, r"([A-Za-z][\w+.-]*://[^?\s]*)\?[^\s'\"]*", "$1")
