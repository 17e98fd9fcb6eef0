"""The public chain: retrieve scenes, derive features, delineate, and convert to rasters or series.

A ``FieldQuery`` holds lazy tables and settings; each step returns a new one and nothing runs before an action.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import date
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import geo, indices
from .operators import boundaries, catalogue, delineate, fusion, georef, raster, retrieval, series, signature
from .plans.calibration import Invocation, snapshot
from .plans.params import DEFAULTS, UNSET, Params, iso_date, resolved


#: Columns that the tables of a query need.
NEEDED = {"scenes": ("site_id", "scene_date", "r", "c"), "detection": ("site_id", "scene_date", "r", "c", "v"), "seeds": ("site_id", "r0", "c0", "rmax")}


@dataclass(frozen=True)
class FieldQuery:
    """scenes: pixels wide by band; detection: pixels of the search index; stages: what delineates; view: the cells that outputs
    show, (site_id, box) on ``grids``, all if None; reader: scenes with the bands of other indices."""

    scenes: DataFrame
    detection: DataFrame
    seeds: DataFrame
    rows: int
    columns: int
    start: str
    end: str
    source: str
    index_name: str
    params: Params = DEFAULTS
    stages: tuple[delineate.Stage, ...] = ()
    prior: DataFrame | None = None
    fused: bool = False
    grids: DataFrame | None = None
    view: DataFrame | None = None
    reader: Callable[[tuple[str, ...]], DataFrame] | None = None
    memory: Invocation = field(default_factory=Invocation, compare=False, repr=False)

    def __post_init__(self):
        for name, needed in NEEDED.items():
            missing = [c for c in needed if c not in getattr(self, name).columns]
            if missing:
                raise ValueError(f"{name} of a query needs the columns {', '.join(missing)}")
        if not isinstance(self.params, Params):
            raise ValueError("params of a query are Params")
        if self.index_name not in indices.FORMULAS:
            raise ValueError(f"unknown index {self.index_name!r}")

    def __repr__(self) -> str:
        return f"FieldQuery({self.source}, {self.index_name}, {self.start}..{self.end}, {self.rows}x{self.columns}, stages={' > '.join(x.name for x in self.stages) or 'none'})"

    def summary(self) -> dict[str, Any]:
        """What the query is; no job runs."""
        return {
            "source": self.source, "index": self.index_name, "search_index": self.params.search_index, "period": (self.start, self.end), "windows": self.windows(), "bands": [c for c in self.scenes.columns if c in indices.BANDS["sentinel-2"]],
            "stages": [x.name for x in self.stages], "set": sorted(self.params.user_set), "prior": self.prior is not None, "fused": self.fused,
        }

    def compose(self, index_name: str) -> FieldQuery:
        """The same scenes with another index; bands that are missing are read late, under the same mask."""
        if index_name not in indices.supported(self.source):
            raise ValueError(f"{self.source} has no {index_name}")
        if set(indices.needed_bands(index_name)) <= set(self.scenes.columns):
            return replace(self, index_name=index_name)
        if self.reader is None or self.fused:
            raise ValueError(f"{index_name} needs bands that the scenes don't have")
        return replace(self, index_name=index_name, scenes=self.reader((index_name, self.params.search_index)))

    def kept(self, folder: str) -> FieldQuery:
        """The query over a copy of its scenes in ``folder`` (shared Parquet), so that nothing is read from remote twice."""
        self.scenes.write.mode("overwrite").parquet(folder)
        scenes = self.scenes.sparkSession.read.schema(self.scenes.schema).parquet(folder)
        return replace(self, scenes=scenes, detection=indices.with_index(scenes, self.params.search_index, "v"), reader=None)

    # -- detection ---------------------------------------------------------------------------------
    def windows(self) -> int:
        first, last = (date.fromisoformat(x) for x in (self.params.search_start_date or self.start, self.params.search_end_date or self.end))
        return raster.window_count((last - first).days, 10 if self.source == "sentinel-2" else 30)

    def features(self) -> DataFrame:
        p = self.params
        return raster.window_features(self.detection, "v", p.search_start_date or self.start, p.search_end_date or self.end, self.windows())

    def calibration(self) -> DataFrame | None:
        """Valid windows' signatures and tolerances; None for an index without a noise floor.

        The support is the prior's cells, one pixel eroded, or else the square around the seed that is large enough for
        the noise floor, up to the largest that the grid holds.
        """
        floor = signature.noise_floor(self.params.search_index)
        if floor is None:
            return None
        features, cell = self.features(), ["site_id", "r", "c"]
        radius = signature.support(features, self.seeds, floor, self.windows())
        block = features.join(self.seeds.select("site_id", "r0", "c0").join(radius, "site_id"), "site_id")
        block = block.where(F.greatest(F.abs(F.col("r") - F.col("r0")), F.abs(F.col("c") - F.col("c0"))) <= F.col("radius")).select(features.columns)
        if self.prior is not None:
            inside = boundaries.eroded(self.prior.select(*cell), ["site_id"])
            block = block.join(self.prior.select("site_id").distinct(), "site_id", "left_anti").unionByName(features.join(inside, cell, "left_semi"))
        fill = self._fill()
        low, high = fill.area_threshold
        return signature.calibrated(signature.long_windows(block, self.windows()), self.params.search_index, fill.strictness, low=low, high=high)

    def _has_mask(self) -> bool:
        return any(x.name in ("area", "boundary") for x in self.stages)

    def _staged(self, stage: str, given: Params | dict | None, inline: dict[str, Any], cleanups: int = 2) -> FieldQuery:
        """What a call sets holds for its own stage."""
        if stage in ("split", "interior") and not self._has_mask():
            raise ValueError(f"{stage} needs an area first")
        return replace(self, stages=(*self.stages, delineate.Stage(stage, resolved(self.params, given, inline), cleanups)))

    def _fill(self) -> Params:
        """The settings of the stage that fills; windows, calibration and areas follow them."""
        return next((x.params for x in self.stages if x.name in ("area", "boundary")), self.params)

    def trace_perimeter(self, params: Params | dict | None = None, perimeter_margins: Any = UNSET, trace_iter: Any = UNSET) -> FieldQuery:
        return self._staged("trace", params, {"perimeter_margins": perimeter_margins, "trace_iter": trace_iter})

    def segment_area(self, params: Params | dict | None = None, **inline: Any) -> FieldQuery:
        return self._staged("area", params, inline)

    def split_area(self, params: Params | dict | None = None, **inline: Any) -> FieldQuery:
        return self._staged("split", params, inline)

    def segment_interior(self, params: Params | dict | None = None, **inline: Any) -> FieldQuery:
        return self._staged("interior", params, inline)

    def boundary_delineation(self, params: Params | dict | None = None, cleanup_boundary: int = 2, **inline: Any) -> FieldQuery:
        """The fixed sequence with ``cleanup_boundary`` (0 to 5) middle pairs; vi_sensitivity and vi_threshold set all of their kind that aren't given."""
        every = {"vi_sensitivity": ("area_sensitivity", "interior_sensitivity", "split_sensitivity"), "vi_threshold": ("area_threshold", "interior_threshold")}
        for name, own in every.items():
            if name in inline:
                value = inline.pop(name)
                inline = {k: value for k in own} | inline
        return self._staged("boundary", params, inline, cleanup_boundary)

    def add_prior(self, cells: DataFrame) -> FieldQuery:
        """cells: (site_id, r, c, strength) of a boundary polygon (boundaries.prior)."""
        return replace(self, prior=cells)

    def diagnose(self, reference: DataFrame | None = None) -> DataFrame:
        """Overlap of the mask with reference cells (the prior's, if none are given)."""
        mask, reference = self.mask(), reference if reference is not None else self.prior
        if mask is None or reference is None:
            raise ValueError("a mask and a reference are needed")
        return boundaries.overlap(mask, reference.select("site_id", "r", "c").distinct(), ["site_id"], ["r", "c"])

    def outlines(self) -> DataFrame:
        """(site_id, area_num, x1, y1, x2, y2): borders of the mask's areas."""
        mask = self.mask()
        if mask is None:
            raise ValueError("there is no mask yet")
        return boundaries.outlines(mask, ["site_id", "area_num"])

    def mask(self) -> DataFrame | None:
        """Mask cells, or None before any delineation."""
        if not self._has_mask():
            return None
        fill = self._fill()
        with Invocation.begin(self.memory) as own:
            key = snapshot(index=self.params.search_index, strictness=fill.strictness, threshold=fill.area_threshold, period=(self.start, self.end, fill.search_start_date, fill.search_end_date), prior=id(self.prior))
            calibration = own.calibrated(key, self.calibration)
        return delineate.delineated(self.features(), self.seeds, self.rows, self.columns, fill, self.stages, self.windows(), calibration, self.prior)

    # -- fusion ------------------------------------------------------------------------------------
    def add_coarse(self, coarse: DataFrame) -> FieldQuery:
        """Estimated scenes on coarse dates without a fine date near; nothing for unsupported indices, fine 10 m scenes or a fused query."""
        if self.fused or self.source == "sentinel-2":
            return self
        if self.index_name in indices.unsupported_by_fusion():
            warnings.warn(f"{self.index_name} has no coarse counterpart; nothing is added", stacklevel=2)
            return self
        bands = indices.needed_bands(self.index_name)
        cell = ["site_id", "scene_date", "r", "c"]
        fine, far = self.scenes.select(*cell, *bands), coarse.select(*cell, *bands)
        days = lambda x: x.select("site_id", "scene_date").distinct()
        pairs = fusion.anchored(days(far), days(fine))
        valued = lambda x: indices.with_index(x, self.index_name, "_index")
        made = fusion.fused(pairs, valued(fine), valued(far), bands, "_index").join(pairs.select("site_id", "scene_date", "anchor_days"), ["site_id", "scene_date"])
        observed = fine.withColumns({"is_fused": F.lit(False), "anchor_days": F.lit(None).cast("int"), "residual": F.lit(None).cast("double"), "anchor_value": F.lit(None).cast("double")})
        both = observed.unionByName(made.select(*cell, *bands, F.lit(True).alias("is_fused"), "anchor_days", "residual", "anchor_value"))
        return replace(self, scenes=both, fused=True)

    def validate_fusion(self, coarse: DataFrame, by: str = "scene", min_valid_n: int = 4) -> DataFrame | None:
        """Leave-one-out agreement by scene or pixel, or the daily series with each scene's agreement beside it; None for an index
        that can't be fused."""
        if by not in ("scene", "pixel", "series"):
            raise ValueError("by is scene, pixel or series")
        if not isinstance(min_valid_n, int) or isinstance(min_valid_n, bool) or min_valid_n < 1:
            raise ValueError("min_valid_n is a positive whole number")
        if self.source not in ("landsat-8", "landsat-5"):
            raise ValueError(f"validation needs Landsat scenes, not {self.source}")
        if self.index_name in indices.unsupported_by_fusion():
            warnings.warn(f"{self.index_name} has no coarse counterpart; nothing is validated", stacklevel=2)
            return None
        if by == "series":
            found = self.validate_fusion(coarse, "scene", min_valid_n).withColumn("date", F.date_format("scene_date", "yyyy-MM-dd")).drop("scene_date")
            return self.as_time_series().join(found, ["site_id", "date"], "left")
        fine = self.scenes.where(~F.col("is_fused")) if self.fused else self.scenes  # estimates are no observations
        pairs = fusion.leave_one_out(fine, coarse, self.index_name)
        return fusion.agreement(pairs, ["site_id", "scene_date"], min_valid_n, "n_pixels") if by == "scene" else fusion.agreement(pairs, ["site_id", "r", "c"], min_valid_n, "n_scenes")

    # -- output ------------------------------------------------------------------------------------
    def _values(self) -> DataFrame:
        return indices.with_index(self.scenes, self.index_name, "v")

    def _shown(self, cells: DataFrame) -> DataFrame:
        """Cells that the requested box touches."""
        return cells if self.view is None else georef.cropped(cells, self.grids, self.view)

    def _told(self, out: DataFrame) -> DataFrame:
        """Where values come from, as metadata of their columns."""
        about = {"source": self.source, "index": self.index_name, "start": self.start, "end": self.end, "stages": [x.name for x in self.stages]}
        for name in out.columns:
            if name in ("v", "value", "union") or name.startswith("area_"):
                out = out.withMetadata(name, about)
        return out

    def _cells(self, mask: DataFrame | None) -> DataFrame | None:
        """A caller's mask as cells, or the delineated one.  Edges of polygons in cell units (x1, y1, x2, y2) keep every cell they touch."""
        if mask is None:
            return self.mask()
        if {"x1", "y1", "x2", "y2"} <= set(mask.columns):
            sizes = max(self.rows, self.columns) or max(self.seeds.agg(F.max("nrow"), F.max("ncol")).first())
            edges = mask if "poly_id" in mask.columns else mask.withColumn("poly_id", F.lit(1))
            mask = boundaries.touched(edges, sizes).select("site_id", "r", "c").distinct().withColumn("area_num", F.lit(1))
        return boundaries.check_mask(mask)

    def as_raster(self, composite: str = "median", mask: DataFrame | None = None, areas: list[int] | None = None) -> DataFrame:
        """(site_id, r, c, v) or area layers: an explicit mask wins; before delineation all cells count; an empty mask empties.
        Cells are composited, then cropped to the requested box."""
        out, mask = self._shown(raster.composite(self._values(), "v", composite)), self._cells(mask)
        if mask is None:
            return self._told(out)
        return self._told(raster.area_layers(out, mask, "v", ["site_id", "r", "c"], areas) if areas else raster.masked(out, mask, "v", ["site_id", "r", "c"]))

    def as_time_series(self, every: str = "daily", how: str = "mean", mask: DataFrame | None = None, areas: list[int] | None = None) -> DataFrame:
        """(site_id, date, value), or a column for each area and their union; on a fused query estimates give way to
        observations of the day and stay marked, with is_fused, anchor_days, anchor_mae and anchor_nmae.  Cells are cropped to
        the requested box, then aggregated."""
        own, mask = self._shown(self._values()), self._cells(mask)
        if self.fused:
            return self._told(series.fused_series(own, "v", every, how, mask, areas if mask is not None else None))
        if mask is not None and areas:
            return self._told(series.area_series(own, mask, "v", areas, every, how))
        if mask is not None:
            own = own.join(mask.select("site_id", "r", "c").distinct(), ["site_id", "r", "c"], "left_semi")
        return self._told(series.series(own, "v", every, how))


def _period(start: str, end: str, source: str) -> tuple[str, str, str]:
    """Both ends of a period of two days at least, and the sensor that has it."""
    first, last = iso_date(start, "start"), iso_date(end, "end")
    if first is None or last is None:
        raise ValueError("start and end are needed")
    if (date.fromisoformat(last) - date.fromisoformat(first)).days < 2:
        raise ValueError("the period needs two days at least")
    return first, last, catalogue.check_source(source, first)


def retrieve(scenes: DataFrame, seeds: DataFrame, rows: int, columns: int, start: str, end: str, index_name: str = "EVI2", source: str = "auto", params: Params = DEFAULTS) -> FieldQuery:
    """A query over pixel rows (site_id, scene_date, r, c, bands).  All arguments are checked before any plan is built."""
    first, last, source = _period(start, end, source)
    if index_name not in indices.supported(source):
        raise ValueError(f"{source} has no {index_name}")
    own = scenes.where(F.col("scene_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    detection = indices.with_index(own, params.search_index, "v")
    if "rmax" not in seeds.columns:  # the largest complete square of the grid
        r, c = F.col("r0"), F.col("c0")
        seeds = seeds.withColumn("rmax", F.least(r - 1, F.lit(rows) - r, c - 1, F.lit(columns) - c).cast("int"))
    return FieldQuery(own, detection, seeds, rows, columns, first, last, source, index_name, params)


def get_scenes(
    sites: DataFrame, items: DataFrame, pixels: DataFrame, grids: DataFrame, start: str, end: str, index_name: str = "EVI2", source: str = "auto", params: Params = DEFAULTS,
    max_cloud: float | None = 50, mask: list[int] | None = None, x_metres: float = 1000, y_metres: float | None = None,
) -> FieldQuery:
    """A query over the scenes of sites (site_id, longitude, latitude): search, reading, cleaning and mosaics (operators/retrieval.py),
    seed cells and their limits from the sites' grids.  All arguments are checked before any plan is built.

    Grids are cut to the requested box, snapped outward, and numbered anew.  A site whose box misses its grid gives nothing;
    one whose point lies outside the cut grid is an error when the query runs.
    """
    first, last, source = _period(start, end, source)
    for name in (index_name, params.search_index):
        if name not in indices.supported(source):
            raise ValueError(f"{source} has no {name}")
    for metres in (x_metres, y_metres):
        if metres is not None and not 0 < metres < float("inf"):
            raise ValueError("a box needs a positive width and height in metres")
    if max_cloud is not None and not 0 <= max_cloud <= 100:
        raise ValueError("max_cloud is a share from 0 to 100")
    wide, high = F.lit(float(x_metres)), F.lit(float(y_metres or x_metres))
    around = geo.with_box(sites, F.col("longitude"), F.col("latitude"), wide, high).select("site_id", F.lit(4326).alias("epsg"), "box")
    boxes = georef.moved_boxes(around, grids)
    own = georef.cropped_grid(grids, boxes)
    view = georef.moved_boxes(georef.analysed_box(sites.select("site_id", F.col("longitude").alias("lon"), F.col("latitude").alias("lat")), wide, high), own)

    def reader(names: tuple[str, ...]) -> DataFrame:
        found = retrieval.scenes(sites, items, pixels, source, first, last, names, max_cloud, mask, params.s2_processing, x_metres, y_metres)
        return georef.renumbered(found, grids, boxes)

    scenes = reader((index_name, params.search_index))
    placed = sites.join(own.select("site_id", "epsg"), "site_id")
    points = geo.with_xy(placed, F.col("longitude"), F.col("latitude"), F.col("epsg")).select("site_id", "x", "y")
    seeds = georef.checked_seeds(georef.seeds(points, own)).join(own.select("site_id", "nrow", "ncol"), "site_id")
    detection = indices.with_index(scenes, params.search_index, "v")
    return FieldQuery(scenes, detection, seeds, 0, 0, first, last, source, index_name, params, grids=own, view=view, reader=reader)


def is_query(x: object) -> bool:
    return isinstance(x, FieldQuery)
