"""Readers of catalogues, pixel assets and boundaries.

The offline form of each is Parquet, where date, box and cloud predicates reach the scan.  ``StacSource`` is the live
form: a Python data source over a search function that gives pages of items, one partition for each slice of the period.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.reflectance import sensor
from ..operators import catalogue as ops
from ..plans.batch import fetched

ITEMS = "item_id string, collection string, platform string, datetime string, cloud double, xmin double, ymin double, xmax double, ymax double, assets map<string,string>"


def catalogue(spark: SparkSession, path: str, source: str, start: str, end: str, max_cloud: float | None = 50, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Items of a sensor's collection in a Parquet catalogue."""
    own = sensor(source)
    items = spark.read.parquet(path)
    items = items.where(items["collection"] == own.collection)
    return ops.items(items, start, end, None if source == "mcd43a4" else max_cloud, own.platforms, box)


#: What is read of an item's JSON text.
ITEM_JSON = "id string, collection string, bbox array<double>, properties struct<datetime:string,start_datetime:string,platform:string,`eo:cloud_cover`:double,`s2:mgrs_tile`:string,`sat:relative_orbit`:int,`s2:processing_baseline`:string,`s2:generation_time`:string>, assets map<string,struct<href:string>>"


def items_from_json(texts: DataFrame, column: str = "text") -> DataFrame:
    """Catalogue rows from items as JSON text; a text that can't be read goes."""
    from pyspark.sql import functions as F

    own = texts.select(F.from_json(column, ITEM_JSON).alias("i")).where("i.id is not null")
    p = "i.properties"
    return own.select(
        F.col("i.id").alias("item_id"), F.col("i.collection").alias("collection"), F.col(f"{p}.platform").alias("platform"), F.col(f"{p}.datetime").alias("datetime"), F.col(f"{p}.start_datetime").alias("start_datetime"),
        F.col(f"{p}.`eo:cloud_cover`").alias("cloud"), *(F.get("i.bbox", F.lit(k)).alias(n) for k, n in enumerate(("xmin", "ymin", "xmax", "ymax"))),
        F.col(f"{p}.`s2:mgrs_tile`").alias("mgrs_tile"), F.col(f"{p}.`sat:relative_orbit`").alias("relative_orbit"), F.col(f"{p}.`s2:processing_baseline`").alias("baseline"), F.col(f"{p}.`s2:generation_time`").alias("generation"),
        F.transform_values("i.assets", lambda k, v: v["href"]).alias("assets"),
    )


def signed_text(href: str, token: str | None) -> str:
    """An address with an access token appended."""
    return href if not token else f"{href}{'&' if '?' in href else '?'}{token}"


def pixels(spark: SparkSession, path: str, bands: list[str], start: str | None = None, end: str | None = None) -> DataFrame:
    """Pixel rows (site_id, scene_date, r, c, bands) of a Parquet table: only the asked bands and days are read, digital numbers as they are."""
    from pyspark.sql import functions as F

    own = spark.read.parquet(path)
    missing = [b for b in bands if b not in own.columns]
    if missing:
        raise ValueError(f"{path} has no {', '.join(missing)}")
    if start is not None:
        own = own.where(F.col("scene_date") >= F.lit(start).cast("date"))
    if end is not None:
        own = own.where(F.col("scene_date") <= F.lit(end).cast("date"))
    return own.select("site_id", "scene_date", "r", "c", *bands)


class _Slice(InputPartition):
    def __init__(self, start: str, end: str):
        self.start, self.end = start, end


class _StacReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        missing = [k for k in ("search", "collection", "start", "end") if k not in options]
        if missing:
            raise ValueError(f"the source needs the options {', '.join(missing)}")
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        first, last = (date.fromisoformat(self.options[k]) for k in ("start", "end"))
        step = timedelta(days=int(self.options.get("days", "31")))
        out = []
        while first <= last:
            out.append(_Slice(first.isoformat(), min(first + step - timedelta(days=1), last).isoformat()))
            first += step
        return out

    def read(self, partition: _Slice) -> Iterator[tuple]:
        import importlib

        module, _, name = self.options["search"].partition(":")
        search = getattr(importlib.import_module(module), name)
        query = {"collection": self.options["collection"], "start": partition.start, "end": partition.end + "T23:59:59.999999Z", "box": self.options.get("box"), "max_cloud": self.options.get("max_cloud")}
        # a slice's pages are fetched whole, so a try that fails halfway leaves no rows
        pages = fetched(lambda: list(search(**query)), int(self.options.get("tries", "10")), float(self.options.get("pause", "2")))
        sign = self.options.get("token")
        for page in pages:
            for item in page:
                p, b = item["properties"], item.get("bbox") or [None] * 4
                cloud = p.get("eo:cloud_cover")
                yield (item["id"], item.get("collection"), p.get("platform"), p.get("datetime") or p.get("start_datetime"), None if cloud is None else float(cloud), *b, {k: signed_text(a["href"], sign) for k, a in item.get("assets", {}).items()})


class StacSource(DataSource):
    """``spark.dataSource.register(StacSource)``, then ``spark.read.format("stac").options(search="module:function", ...)``."""

    @classmethod
    def name(cls) -> str:
        return "stac"

    def schema(self) -> str:
        return ITEMS

    def reader(self, schema) -> DataSourceReader:
        return _StacReader(self.options)


def ring_edges(wkb: bytes) -> np.ndarray:
    """(n, 4) edges x1, y1, x2, y2 of all rings of a WKB polygon or multipolygon."""
    out: list[np.ndarray] = []

    def polygon(at: int, order: str) -> int:
        (rings,) = struct.unpack_from(order + "I", wkb, at)
        at += 4
        for _ in range(rings):
            (n,) = struct.unpack_from(order + "I", wkb, at)
            xy = np.frombuffer(wkb, order + "f8", 2 * n, at + 4).reshape(-1, 2)
            out.append(np.hstack([xy[:-1], xy[1:]]))
            at += 4 + 16 * n
        return at

    def geometry(at: int) -> int:
        order = "<" if wkb[at] else ">"
        (kind,) = struct.unpack_from(order + "I", wkb, at + 1)
        at += 5
        if kind & 0x20000000:
            at += 4
            kind &= ~0x20000000
        if kind == 3:
            return polygon(at, order)
        if kind != 6:
            raise ValueError(f"WKB type {kind} is no polygon")
        (n,) = struct.unpack_from(order + "I", wkb, at)
        at += 4
        for _ in range(n):
            at = geometry(at)
        return at

    geometry(0)
    return np.concatenate(out) if out else np.zeros((0, 4))


def boundaries(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, geometry: str = "geometry", year: str = "source_year") -> DataFrame:
    """Edges (poly_id, source_year, x1, y1, x2, y2) of a Parquet file of WKB polygons.

    With box columns (xmin..ymax) in the file the box prunes row groups; without, polygons are decoded and tested.
    """
    found = spark.read.parquet(path)
    if box is not None and {"xmin", "ymin", "xmax", "ymax"} <= set(found.columns):
        found = found.where((found["xmax"] >= box[0]) & (found["xmin"] <= box[2]) & (found["ymax"] >= box[1]) & (found["ymin"] <= box[3]))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, years, parts = [], [], []
            for k, y, g in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                edges = ring_edges(g) if g is not None else np.zeros((0, 4))
                if len(edges) and box is not None and (edges[:, 0].max() < box[0] or edges[:, 0].min() > box[2] or edges[:, 1].max() < box[1] or edges[:, 1].min() > box[3]):
                    continue
                ids += [k] * len(edges)
                years += [y] * len(edges)
                parts.append(edges)
            flat = np.concatenate([np.zeros((0, 4)), *parts])
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(years, pa.int32()), *(pa.array(flat[:, k]) for k in range(4))], names=["poly_id", "source_year", "x1", "y1", "x2", "y2"])

    own = found.selectExpr("CAST(poly_id AS BIGINT) AS poly_id", f"CAST({year} AS INT) AS source_year", f"{geometry} AS g")
    return own.mapInArrow(decode, "poly_id long, source_year int, x1 double, y1 double, x2 double, y2 double")
