"""Spectral indices as built-in expressions.

A formula is written once over normalised band names and rendered for Spark (``try_divide``) or DuckDB; a missing or
non-finite result is NULL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Divide = Callable[[str, str], str]


def _ratio(a: str, b: str) -> Callable[[Divide], str]:
    return lambda d: d(a, b)


def _difference(a: str, b: str) -> Callable[[Divide], str]:
    return lambda d: d(f"({a}) - ({b})", f"({a}) + ({b})")


_NDVI = _difference("nir", "red")
_ROOT = "power(2 * nir + 1, 2) - 8 * (nir - red)"

# Formulas over the band names blue, green, red, re1, re2, re3, nir, swir1, swir2.
FORMULAS: dict[str, Callable[[Divide], str]] = {
    "NDVI": _NDVI,
    "DVI": lambda d: "nir - red",
    "kNDVI": lambda d: f"tanh(power({_NDVI(d)}, 2))",
    "GNDVI": _difference("nir", "green"),
    "BNDVI": _difference("nir", "blue"),
    "GBNDVI": _difference("nir", "green + blue"),
    "GRNDVI": _difference("nir", "green + red"),
    "NIRv": lambda d: f"({_NDVI(d)}) * nir",
    "NDWI": _difference("green", "nir"),
    "NDMI": _difference("nir", "swir1"),
    "EVI": _ratio("2.5 * (nir - red)", "nir + 6 * red - 7.5 * blue + 1"),
    "SAVI": lambda d: f"{d('nir - red', 'nir + red + 0.5')} * 1.5",
    "MSAVI": lambda d: f"(2 * nir + 1 - CASE WHEN {_ROOT} >= 0 THEN sqrt({_ROOT}) END) / 2",
    "NDRE": _difference("nir", "re1"),
    "MTCI": _ratio("re2 - re1", "re1 - red"),
    "CIre_gitelson": lambda d: f"{d('re3', 're1')} - 1",
    "CIRE": lambda d: f"{d('nir', 're1')} - 1",
    "PSRI": _ratio("red - blue", "re2"),
    "BSI": _difference("swir1 + red", "nir + blue"),
    "SR": _ratio("nir", "red"),
    "EVI2": _ratio("2.5 * (nir - red)", "nir + 2.4 * red + 1"),
    "OSAVI": _ratio("nir - red", "nir + red + 0.16"),
    "ARVI": _difference("nir", "2 * red - blue"),
    "GARI": _difference("nir", "green - (blue - red)"),
    "CIG": lambda d: f"{d('nir', 'green')} - 1",
    "MNDWI": _difference("green", "swir1"),
    "NBR": _difference("nir", "swir2"),
    "NBR2": _difference("swir1", "swir2"),
    "BAI": _ratio("1", "power(0.1 - red, 2) + power(0.06 - nir, 2)"),
    "MCARI": lambda d: f"((re1 - red) - 0.2 * (re1 - green)) * ({d('re1', 'red')})",
    "IRECI": lambda d: d("re3 - red", f"({d('re1', 're2')})"),
}

# Source bands of each sensor under their normalised names.
BANDS = {
    "sentinel-2": {"blue": "B02", "green": "B03", "red": "B04", "re1": "B05", "re2": "B06", "re3": "B07", "nir": "B08", "swir1": "B11", "swir2": "B12"},
    "landsat-8": {"blue": "blue", "green": "green", "red": "red", "nir": "nir08", "swir1": "swir16", "swir2": "swir22"},
    "landsat-5": {"blue": "blue", "green": "green", "red": "red", "nir": "nir08", "swir1": "swir16", "swir2": "swir22"},
    "mcd43a4": {"red": "Band1", "nir": "Band2", "blue": "Band3", "swir2": "Band7"},
}
#: A coarse sensor offers fewer indices than its bands allow.
COARSE = ("NDVI", "EVI", "DVI", "kNDVI", "BNDVI", "NIRv", "SAVI", "MSAVI", "SR", "EVI2", "OSAVI", "ARVI", "NBR", "BAI")


def needed_bands(name: str) -> list[str]:
    """Normalised bands that an index reads."""
    if name not in FORMULAS:
        raise ValueError(f"unknown index {name!r}; known: {', '.join(FORMULAS)}")
    import re

    words = set(re.findall(r"[a-z]+\d?", FORMULAS[name](lambda a, b: f"({a})/({b})")))
    return [b for b in BANDS["sentinel-2"] if b in words]


def supported(sensor: str) -> list[str]:
    """Indices that a sensor's bands allow."""
    if sensor == "mcd43a4":
        return list(COARSE)
    return [n for n in FORMULAS if set(needed_bands(n)) <= set(BANDS[sensor])]


def unsupported_by_fusion() -> list[str]:
    """Fine indices without a coarse counterpart."""
    return [n for n in supported("landsat-8") if n not in COARSE]


def index_sql(name: str, dialect: str = "spark") -> str:
    needed_bands(name)
    divide = (lambda a, b: f"try_divide({a}, {b})") if dialect == "spark" else (lambda a, b: f"(({a}) / nullif({b}, 0))")
    return FORMULAS[name](divide)


def finite(value: Column) -> Column:
    """NULL for NaN (which Spark orders above all numbers) and infinities."""
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def index(name: str) -> Column:
    return finite(F.expr(index_sql(name)).cast("double"))


def with_index(bands: DataFrame, name: str, out: str = "value") -> DataFrame:
    """``bands`` with the index; names the bands that are missing."""
    missing = [b for b in needed_bands(name) if b not in bands.columns]
    if missing:
        raise ValueError(f"{name} needs the bands {', '.join(missing)}")
    return bands.withColumn(out, index(name))


def normalised(scenes: DataFrame, sensor: str) -> DataFrame:
    """Source bands under their normalised names; an absent band stays absent."""
    names = {source: band for band, source in BANDS[sensor].items() if source in scenes.columns}
    return scenes.withColumnsRenamed(names)
