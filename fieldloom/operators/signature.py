"""Robust spectral statistics of windows and their calibration."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
STRICTNESS = {"loose": 3.0, "balanced": 2.2, "tight": 1.5}
MAD_SCALE = 1.4826
SE_SCALE = 1.166
MULTIMODAL = 3.0
SIGMA, NIR, RED = 0.005, 0.40, 0.05


def strictness_k(name: str) -> float:
    if name not in STRICTNESS:
        raise ValueError(f"strictness is one of {', '.join(STRICTNESS)}")
    return STRICTNESS[name]


def noise_floor(index: str) -> float | None:
    """First-order noise of an index at a representative reflectance; None where no formula is kept."""
    if index == "NDVI":
        total = (NIR + RED) ** 2
        return SIGMA * math.hypot(2 * RED / total, 2 * NIR / total)
    if index == "EVI2":
        below = (NIR + 2.4 * RED + 1) ** 2
        return SIGMA * math.hypot(2.5 * (3.4 * RED + 1) / below, 2.5 * (3.4 * NIR + 1) / below)
    return None


def long_windows(features: DataFrame, windows: int = 3) -> DataFrame:
    """(site_id, r, c, w, v) of the wide features' values."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("w"), F.col(f"w{k}").alias("v")) for k in range(1, windows + 1))))
    return features.select("site_id", "r", "c", pairs.alias("x")).select("site_id", "r", "c", "x.w", "x.v")


def signature(values: DataFrame, keys: tuple[str, ...] = ("site_id", "w")) -> DataFrame:
    """(keys, n, mu, disp): count, median and scaled median absolute deviation of finite values; NULL under two."""
    own = values.where("v is not null")
    median = own.groupBy(*keys).agg(F.count("v").alias("n"), F.median("v").alias("mu"))
    spread = own.join(median, list(keys)).groupBy(*keys).agg(F.median(F.abs(F.col("v") - F.col("mu"))).alias("mad"))
    two = F.col("n") >= 2
    return median.join(spread, list(keys)).select(*keys, "n", F.when(two, F.col("mu")).alias("mu"), F.when(two, F.lit(MAD_SCALE) * F.col("mad")).alias("disp"))


def tolerance(disp: Column, n: Column, k: float, c_noise: float, n_min: int, low: float, high: float) -> tuple[Column, Column]:
    """Tolerance and the first reason against it.  Missing dispersion stays missing (``greatest`` alone would skip it)."""
    tol = F.when(disp.isNotNull(), F.greatest(F.lit(k) * disp, F.lit(c_noise)))
    limit = (high - low) / (2 * k)
    return tol, F.when(n < n_min, "n_below_min").when(disp.isNull(), "disp_na").when(disp >= limit, "disp_crossover")


def seed_block(features: DataFrame, seeds: DataFrame, radius: int = 1) -> DataFrame:
    """Cells within a square around each site's seed (r0, c0); clamped by the grid itself.  One seed for a site, so no row is repeated."""
    own = features.join(seeds.select("site_id", "r0", "c0"), "site_id")
    return own.where((F.abs(F.col("r") - F.col("r0")) <= radius) & (F.abs(F.col("c") - F.col("c0")) <= radius))


def learned(features: DataFrame, seeds: DataFrame, sensitivity: float, low: float, high: float, windows: int = 3) -> DataFrame:
    """(site_id, w, mu): median of the seed's 3x3 block among cells strictly within ``sensitivity`` of the seed and inside
    the thresholds; the seed's own value below two of them; NULL for a missing seed."""
    block = seed_block(features, seeds, 1)
    at_seed = F.when((F.col("r") == F.col("r0")) & (F.col("c") == F.col("c0")), F.struct(*(F.col(f"w{k}") for k in range(1, windows + 1))))
    with_seed = block.withColumn("_seed", F.max(at_seed).over(Window.partitionBy("site_id")))
    pairs = F.array(*(F.struct(F.lit(k).alias("w"), F.col(f"w{k}").alias("v"), F.col(f"_seed.w{k}").alias("s")) for k in range(1, windows + 1)))
    each = with_seed.select("site_id", F.explode(pairs).alias("x")).select("site_id", "x.*")
    fits = (F.abs(F.col("v") - F.col("s")) < sensitivity) & F.col("v").between(low, high)
    out = each.groupBy("site_id", "w").agg(F.count(F.when(fits, F.col("v"))).alias("n"), F.median(F.when(fits, F.col("v"))).alias("m"), F.max("s").alias("s"))
    return out.select("site_id", "w", F.when(F.col("s").isNull(), F.lit(None).cast("double")).when(F.col("n") >= 2, F.col("m")).otherwise(F.col("s")).alias("mu"))


def mode_gap(values: DataFrame, c_noise: float, keys: tuple[str, ...] = ("site_id", "w")) -> DataFrame:
    """(keys, sep): largest gap between neighbours in order, 5% (one at least) trimmed at both ends, against the dispersion; NULL under eight."""
    own = values.where("v is not null")
    order = Window.partitionBy(*keys).orderBy("v")
    ranked = own.withColumns({"_i": F.row_number().over(order), "_n": F.count("v").over(Window.partitionBy(*keys))})
    trim = F.greatest(F.lit(1), F.floor(F.col("_n") * 0.05))
    kept = ranked.where((F.col("_i") > trim) & (F.col("_i") <= F.col("_n") - trim))
    gaps = kept.withColumn("_gap", F.col("v") - F.lag("v").over(order)).groupBy(*keys).agg(F.max("_gap").alias("gap"), F.max("_n").alias("n"))
    spread = signature(values, keys).select(*keys, "disp")
    return gaps.join(spread, list(keys)).select(*keys, F.when(F.col("n") >= 8, F.col("gap") / F.greatest("disp", F.lit(c_noise))).alias("sep"))


def support(features: DataFrame, seeds: DataFrame, c_noise: float, windows: int = 3) -> DataFrame:
    """(site_id, radius): smallest radius from 2 (or the grid's limit ``rmax``) at which every measurable window's standard
    error is at most the noise floor, else the limit.  A window is measurable if the largest square holds two values of it;
    the radius stays at its start if none is.  One kernel call a site widens the square and stops as the search does."""
    names = [f"w{k}" for k in range(1, windows + 1)]
    ring = F.greatest(F.abs(F.col("r") - F.col("r0")), F.abs(F.col("c") - F.col("c0")))
    cells = features.join(seeds.select("site_id", "r0", "c0", "rmax"), "site_id").where(ring <= F.col("rmax"))

    def widened(own: pd.DataFrame) -> pd.DataFrame:
        limit = int(own["rmax"].iloc[0])
        own = own.sort_values("ring", kind="stable")
        rings, grid = own["ring"].to_numpy(), own[names].to_numpy(float)
        measurable = [k for k in range(windows) if np.isfinite(grid[:, k]).sum() >= 2]
        radius = min(2, limit)
        while measurable and radius < limit and not all(_precise(grid[: np.searchsorted(rings, radius, "right"), k], c_noise) for k in measurable):
            radius += 1
        return pd.DataFrame({"site_id": own["site_id"].iloc[:1], "radius": [radius]})

    kind = features.schema["site_id"].dataType.simpleString()
    found = cells.select("site_id", "rmax", ring.alias("ring"), *names).groupBy("site_id").applyInPandas(widened, f"site_id {kind}, radius int")
    return seeds.select("site_id", "rmax").join(found, "site_id", "left").select("site_id", F.coalesce("radius", F.least(F.lit(2), "rmax")).cast("int").alias("radius"))


def _precise(values: np.ndarray, c_noise: float) -> bool:
    own = values[np.isfinite(values)]
    return len(own) >= 2 and SE_SCALE * (MAD_SCALE * np.median(np.abs(own - np.median(own)))) / math.sqrt(len(own)) <= c_noise


def calibrated(values: DataFrame, index: str, strictness: str = "balanced", n_min: int = 5, low: float = 0.2, high: float = 0.7) -> DataFrame:
    """(site_id, w, n, mu, disp, tol, reason, sep, multimodal, valid) from support cells (site_id, w, v)."""
    k, floor = strictness_k(strictness), noise_floor(index)
    if floor is None:
        raise ValueError(f"no noise floor for {index}")
    stats = signature(values)
    tol, reason = tolerance(F.col("disp"), F.col("n"), k, floor, n_min, low, high)
    out = stats.withColumns({"tol": tol, "reason": reason}).join(mode_gap(values, floor), ["site_id", "w"], "left")
    multimodal = F.coalesce(F.col("sep") >= MULTIMODAL, F.lit(False))
    return out.withColumn("multimodal", multimodal).withColumn("valid", F.col("reason").isNull() & ~F.col("multimodal"))
