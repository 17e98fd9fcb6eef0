"""Delineation of many sites: one kernel call for each site, sites in parallel.

A site's group is its grid, whose size the query fixes; sites never meet in one call.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.params import DEFAULTS, Params
from . import kernel

STAGES = ("trace", "area", "split", "interior", "boundary")


@dataclass(frozen=True)
class Stage:
    """A stage with the settings of its own call and, for the boundary sequence, the number of its middle pairs."""

    name: str
    params: Params | None = None
    cleanups: int = 2

    def __post_init__(self):
        if self.name not in STAGES:
            raise ValueError(f"unknown stage {self.name!r}; known: {', '.join(STAGES)}")
        kernel.check_cleanups(self.cleanups)

    def run(self, site: kernel.Site, default: Params) -> None:
        site.params = self.params or default
        site.boundary(self.cleanups) if self.name == "boundary" else getattr(site, self.name)()


def _with_site(group, out):
    """``out`` with the group's site_id in front, of whatever type the caller's is."""
    import pandas as pd

    out.insert(0, "site_id", pd.Series([group["site_id"].iloc[0]] * len(out), dtype=group["site_id"].dtype, index=out.index))
    return out


def _cube(group, windows: int, rows: int, columns: int) -> np.ndarray:
    cube = np.full((rows, columns, windows), np.nan)
    r, c = group["r"].to_numpy() - 1, group["c"].to_numpy() - 1
    for w in range(windows):
        cube[r, c, w] = group[f"w{w + 1}"].to_numpy(dtype=float, na_value=np.nan)
    return cube


def delineated(features: DataFrame, seeds: DataFrame, rows: int, columns: int, params: Params = DEFAULTS, stages: tuple[Stage | str, ...] = ("boundary",), windows: int = 3, calibration: DataFrame | None = None, prior: DataFrame | None = None) -> DataFrame:
    """Mask cells (site_id, r, c, area_num, decided) after the stages, each under its own settings or ``params``.

    features: (site_id, r, c, w1..); seeds: (site_id, r0, c0), with nrow and ncol where sites have grids of their own sizes
    (``rows`` and ``columns`` count for none then); calibration: (site_id, w, mu, tol, valid) of valid windows;
    prior: (site_id, r, c, strength) of a polygon's cells.  A site without a mask gives no rows.
    """
    stages = tuple(Stage(x) if isinstance(x, str) else x for x in stages)
    kind = features.schema["site_id"].dataType.simpleString()
    sized = {"nrow", "ncol"} <= set(seeds.columns)
    own = features.join(seeds.select("site_id", "r0", "c0", *(("nrow", "ncol") if sized else ())), "site_id")
    if calibration is not None:
        usable = calibration.where("valid").groupBy("site_id").agg(F.map_from_entries(F.collect_list(F.struct("w", F.struct("mu", "tol")))).alias("_cal"))
        own = own.join(usable, "site_id", "left")
        for k in range(1, windows + 1):
            own = own.withColumns({f"_mu{k}": F.col("_cal")[k]["mu"], f"_tol{k}": F.col("_cal")[k]["tol"]})
        own = own.drop("_cal")
    if prior is not None:
        own = own.join(prior.select("site_id", "r", "c", F.col("strength").alias("_prior")), ["site_id", "r", "c"], "left")
    use_calibration = calibration is not None and "area_sensitivity" not in params.user_set

    def run(group):
        import pandas as pd

        cube = _cube(group, windows, *((int(group["nrow"].iloc[0]), int(group["ncol"].iloc[0])) if sized else (rows, columns)))
        seed = (int(group["r0"].iloc[0]) - 1, int(group["c0"].iloc[0]) - 1)
        mu = tol = polygon = None
        strength = 0.0
        if use_calibration and group["_mu1"].notna().any() | any(group[f"_mu{k}"].notna().any() for k in range(1, windows + 1)):
            mu = np.array([float(group[f"_mu{k}"].iloc[0]) for k in range(1, windows + 1)])
            tol = np.array([float(group[f"_tol{k}"].iloc[0]) for k in range(1, windows + 1)])
        if "_prior" in group and group["_prior"].notna().any():
            held = group[group["_prior"].notna()]
            polygon = np.zeros(cube.shape[:2], bool)
            polygon[held["r"].to_numpy() - 1, held["c"].to_numpy() - 1] = True
            strength = float(held["_prior"].iloc[0])
        site = kernel.Site(cube, seed, params, mu, tol, polygon, strength)
        for stage in stages:
            stage.run(site, params)
        cells = [(r + 1, c + 1, a.rank, bool(site.decided[r, c])) for a in kernel.separated(site.mask, seed, params.area_separation_strict) for r, c in a.cells] if site.mask is not None and site.mask.any() else []
        out = pd.DataFrame(cells, columns=["r", "c", "area_num", "decided"]).astype({"r": "int32", "c": "int32", "area_num": "int32", "decided": bool})
        return _with_site(group, out)

    run.__annotations__ = {}
    return own.groupBy("site_id").applyInPandas(run, f"site_id {kind}, r int, c int, area_num int, decided boolean")


def labelled(mask: DataFrame, seeds: DataFrame, rows: int, columns: int, four: bool = False) -> DataFrame:
    """(site_id, r, c, label) of connected cells, by the kernel; labels in column order of first cells."""

    def run(group):
        import pandas as pd

        grid = np.zeros((rows, columns), bool)
        grid[group["r"].to_numpy() - 1, group["c"].to_numpy() - 1] = True
        cells = [(r + 1, c + 1, a.label) for a in kernel.areas(grid, (0, 0), four) for r, c in a.cells]
        out = pd.DataFrame(cells, columns=["r", "c", "label"]).astype("int32")
        return _with_site(group, out)

    kind = mask.schema["site_id"].dataType.simpleString()
    return mask.groupBy("site_id").applyInPandas(run, f"site_id {kind}, r int, c int, label int")
