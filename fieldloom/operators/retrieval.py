"""From a catalogue to scenes: which items concern which site, which assets are read, and their pixels as clean mosaics.

Items are rows (item_id, datetime, start_datetime, platform, cloud, xmin, ymin, xmax, ymax, assets map<string,string>, and
for Sentinel-2 mgrs_tile, relative_orbit, baseline, generation).  Assets are rows of digital numbers (href, r, c, dn) on
their site's grid, so a band that no index needs is never read.  All sites of a run share one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, indices, reflectance
from . import catalogue, raster

#: Columns that tell acquisitions of Sentinel-2 apart.
IDENTITY = ("platform", "mgrs_tile", "relative_orbit", "instant")
TILE = 1.0


def acquired(first: Column | None = None, second: Column | None = None) -> Column:
    """The day in an item's datetime, or start_datetime if that is missing or empty; NULL if it can't be read."""
    first = F.col("datetime") if first is None else first
    second = F.col("start_datetime") if second is None else second
    text = F.coalesce(F.when(first != "", first), second)
    return F.substring(text, 1, 10).try_cast("date")


def in_period(items: DataFrame, start: str, end: str) -> DataFrame:
    """Items whose product day lies in the period, both ends in: a source window that only touches it doesn't count."""
    return items.withColumn("scene_date", acquired()).where(F.col("scene_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def _tiles(frame: DataFrame, box: tuple[Column, Column, Column, Column], size: float) -> DataFrame:
    """``frame`` once for every square of ``size`` degrees that its box touches."""
    steps = lambda low, high: F.sequence(F.floor(low / size).cast("int"), F.floor(high / size).cast("int"))
    return frame.withColumn("_tx", F.explode(steps(box[0], box[2]))).withColumn("_ty", F.explode(steps(box[1], box[3])))


def of_sites(items: DataFrame, sites: DataFrame, size: float = TILE) -> DataFrame:
    """(site_id, items' columns): every item whose box overlaps a site's (column box), touching borders not counted.

    Both sides are dealt to the squares they touch, so the join has an equality; a pair counts in the square that holds
    the south-west corner of its overlap, so no distinct is needed.  A box of the whole world touches a bounded number
    of squares.
    """
    left = _tiles(items, tuple(F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")), size)
    right = _tiles(sites.select("site_id", F.col("box").alias("_box")), tuple(F.col(f"_box.{c}") for c in ("xmin", "ymin", "xmax", "ymax")), size)
    joined = left.join(right, ["_tx", "_ty"])
    overlap = (F.col("xmin") < F.col("_box.xmax")) & (F.col("xmax") > F.col("_box.xmin")) & (F.col("ymin") < F.col("_box.ymax")) & (F.col("ymax") > F.col("_box.ymin"))
    corner = lambda a, b: F.floor(F.greatest(F.col(a), F.col(b)) / size).cast("int")
    own = (corner("xmin", "_box.xmin") == F.col("_tx")) & (corner("ymin", "_box.ymin") == F.col("_ty"))
    return joined.where(overlap & own).drop("_tx", "_ty", "_box")


def signed(href: Column, token: str | None) -> Column:
    """An address with an access token appended; as it is without one."""
    if token is None:
        return href
    return F.when(F.instr(href, "?") > 0, F.concat(href, F.lit("&"), F.lit(token))).otherwise(F.concat(href, F.lit("?"), F.lit(token)))


def asset_rows(items: DataFrame, assets: list[str], token: str | None = None) -> DataFrame:
    """(item_id, asset, href, path) of the wanted assets that an item has, each address once; path: the address without its query."""
    wanted = F.map_filter("assets", lambda k, v: k.isin(*assets) & v.isNotNull())
    out = items.select("item_id", F.explode(wanted).alias("asset", "path")).distinct()
    return out.select("item_id", "asset", signed(F.col("path"), token).alias("href"), F.regexp_replace("path", r"\?.*$", "").alias("path"))


def read(items: DataFrame, pixels: DataFrame, assets: list[str]) -> DataFrame:
    """(site_id, item_id, scene_date, dn_offset, r, c, assets): digital numbers of the wanted assets side by side.

    ``pixels`` (href, r, c, dn) is joined on the address and pivoted over the fixed list of assets by one aggregate.
    """
    rows = asset_rows(items, assets)
    found = rows.join(pixels.select(F.col("href").alias("path"), "r", "c", "dn"), "path")
    wide = found.groupBy("item_id", "r", "c").agg(*(F.max(F.when(F.col("asset") == a, F.col("dn"))).alias(a) for a in assets))
    return items.select("site_id", "item_id", "scene_date", "dn_offset").join(wide, "item_id")


def unreadable(items: DataFrame, pixels: DataFrame, assets: list[str]) -> DataFrame:
    """(site_id, items, dropped, first_item, message): items of which no wanted asset could be read, by site, and the first of them."""
    has = asset_rows(items, assets).join(pixels.select(F.col("href").alias("path")).distinct(), "path", "left_semi").select("item_id").distinct().withColumn("_has", F.lit(True))
    each = items.select("site_id", "item_id", "scene_date").join(has, "item_id", "left")
    lost = F.col("_has").isNull()
    out = each.groupBy("site_id").agg(F.count(F.lit(1)).alias("items"), F.count(F.when(lost, 1)).alias("dropped"), F.min(F.when(lost, F.struct("scene_date", "item_id"))).alias("_first"))
    message = F.when(F.col("dropped") > 0, F.concat(F.col("dropped").cast("string"), F.lit(" of "), F.col("items").cast("string"), F.lit(" acquisitions dropped")))
    return out.select("site_id", "items", "dropped", F.col("_first.item_id").alias("first_item"), message.alias("message"))


def offsets(items: DataFrame, source: str) -> DataFrame:
    """``items`` with dn_offset (0 if there is none or the baseline can't be read) and, for a report, offset_known."""
    if source != "sentinel-2":
        return items.withColumns({"dn_offset": F.lit(0), "offset_known": F.lit(True)})
    own = reflectance.baseline_offset(F.col("baseline"))
    return items.withColumns({"dn_offset": F.coalesce(own, F.lit(0)), "offset_known": own.isNotNull()})


def chosen(items: DataFrame, order: str) -> DataFrame:
    """One processing version of each Sentinel-2 acquisition of a site, before anything is read: a pixel that is masked in the
    chosen one is not filled from another."""
    parts = F.split("baseline", r"\.")
    named = items.withColumns({"instant": catalogue.acquisition_instant(F.col("datetime")), "major": F.try_element_at(parts, F.lit(1)).try_cast("int"), "minor": F.try_element_at(parts, F.lit(2)).try_cast("int")})
    return catalogue.select_processing(named, ["site_id", *IDENTITY], order).drop("instant", "major", "minor")


def cleaned(raw: DataFrame, source: str, mask: list[int] | None, bands: dict[str, str]) -> DataFrame:
    """Reflectance under normalised band names; a masked pixel loses every band, whatever index is asked for later."""
    own = reflectance.sensor(source)
    clear = F.lit(True)
    if mask is not None and own.mask is not None:
        clear = reflectance.clear_of_classes(F.col(own.mask), mask) if own.mask_kind == "class" else reflectance.clear_of_bits(F.col(own.mask).cast("int"), mask)
    values = {band: F.when(clear, reflectance.reflectance(F.col(asset), source, F.col("dn_offset"))) for band, asset in bands.items()}
    return raw.select("site_id", "item_id", "scene_date", "r", "c", *(v.alias(b) for b, v in values.items()))


def scenes(
    sites: DataFrame, items: DataFrame, pixels: DataFrame, source: str, start: str, end: str, index_names: tuple[str, ...],
    max_cloud: float | None = 50, mask: list[int] | None = None, order: str = "highest_baseline", x_metres: float = 1000, y_metres: float | None = None,
) -> DataFrame:
    """(site_id, scene_date, r, c, bands): one mosaic of each site and day, with the bands that the indices need.

    sites: (site_id, longitude, latitude).  A site whose box would cross the antimeridian has no box and gives nothing.
    Tiles of a day are merged in the order of their item ids; for coarse scenes a day without one of the bands goes.
    """
    own, coarse = reflectance.sensor(source), source == "mcd43a4"
    boxed = geo.with_box(sites, F.col("longitude"), F.col("latitude"), F.lit(float(x_metres)), F.lit(float(y_metres or x_metres))).select("site_id", "box")
    if coarse:  # footprints of sinusoidal tiles miss neighbours of a seam
        boxed = boxed.withColumn("box", geo.padded(F.col("box")))
    near = of_sites(catalogue.items(in_period(items, start, end), start, end, None if coarse else max_cloud, own.platforms), boxed)
    if source == "sentinel-2":
        near = chosen(near, order)
    needed = [b for b in indices.BANDS[source] if any(b in indices.needed_bands(n) for n in index_names)]
    bands = {b: indices.BANDS[source][b] for b in needed}
    assets = [*bands.values(), *([own.mask] if mask is not None and own.mask else [])]
    clean = cleaned(read(offsets(near, source), pixels, assets), source, mask, bands)
    merged = raster.mosaic(clean, ["site_id", "scene_date", "r", "c"], needed, "item_id")
    return raster.complete_dates(merged, ["site_id", "scene_date"], needed) if coarse else merged


def coarse_near(fine_dates: DataFrame, items: DataFrame, pad: int = 1) -> DataFrame:
    """Coarse items (site_id, scene_date, item_id, ...) within ``pad`` days of a fine date, the first (by id) of each day.

    One scan for all dates: every fine date is spread over its days and joined by equality.
    """
    days = F.explode(F.sequence(F.lit(-pad), F.lit(pad)))
    wanted = fine_dates.select("site_id", F.col("scene_date").alias("_d"), days.alias("_k")).select("site_id", F.expr("date_add(_d, _k)").alias("scene_date")).distinct()
    near = items.join(wanted, ["site_id", "scene_date"], "left_semi")
    rest = [c for c in items.columns if c not in ("site_id", "scene_date", "item_id")]
    first = near.groupBy("site_id", "scene_date").agg(F.min(F.struct("item_id", *rest)).alias("_x")) if rest else near.groupBy("site_id", "scene_date").agg(F.min(F.struct("item_id")).alias("_x"))
    return first.select("site_id", "scene_date", "_x.*")
