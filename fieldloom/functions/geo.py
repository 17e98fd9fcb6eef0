"""Zones, boxes and projection as column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The WGS84 ellipsoid.
A, INVERSE_FLATTENING = 6378137.0, 298.257223563
FLATTENING = 1 / INVERSE_FLATTENING
E2 = FLATTENING * (2 - FLATTENING)


def utm_epsg(lon: Column, lat: Column) -> Column:
    """EPSG code of the zone with the Norwegian and Svalbard exceptions; NULL beyond the zones' latitudes."""
    zone = F.least(F.floor((lon + 180) / 6) + 1, F.lit(60))
    svalbard = F.when(lon < 9, 31).when(lon < 21, 33).when(lon < 33, 35).otherwise(37)
    zone = F.when((lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12), 32).when((lat >= 72) & (lat <= 84) & (lon >= 0) & (lon < 42), svalbard).otherwise(zone)
    return F.when(lat.between(-80, 84) & lon.between(-180, 180), (F.when(lat >= 0, 32600).otherwise(32700) + zone).cast("int"))


def utm_epsg_sql(lon: str, lat: str) -> str:
    zone = f"""CASE WHEN {lat} >= 56 AND {lat} < 64 AND {lon} >= 3 AND {lon} < 12 THEN 32
      WHEN {lat} >= 72 AND {lat} <= 84 AND {lon} >= 0 AND {lon} < 42 THEN CASE WHEN {lon} < 9 THEN 31 WHEN {lon} < 21 THEN 33 WHEN {lon} < 33 THEN 35 ELSE 37 END
      ELSE least(floor(({lon} + 180) / 6) + 1, 60) END"""
    return f"CASE WHEN {lat} BETWEEN -80 AND 84 AND {lon} BETWEEN -180 AND 180 THEN CAST(CASE WHEN {lat} >= 0 THEN 32600 ELSE 32700 END + {zone} AS INT) END"


def _radii(lat: Column) -> tuple[Column, Column]:
    """Metres in a degree of longitude and of latitude."""
    w = F.lit(1.0) - F.lit(E2) * F.pow(F.sin(F.radians(lat)), 2)
    return F.lit(math.pi / 180 * A) * F.cos(F.radians(lat)) / F.sqrt(w), F.lit(math.pi / 180 * A * (1 - E2)) / (w * F.sqrt(w))


def metres_to_degrees(lat: Column, metres: Column) -> tuple[Column, Column]:
    """Degrees of longitude and latitude that span a distance centred on a latitude (Simpson's mean over the band)."""
    half = metres / 2 / _radii(lat)[1]
    low, mid, high = (_radii(lat + k * half) for k in (-1, 0, 1))
    lon, up = ((a + 4 * b + c) / 6 for a, b, c in zip(low, mid, high, strict=True))
    return metres / lon, metres / up


def _radii_sql(lat: str) -> tuple[str, str]:
    w = f"(1.0::DOUBLE - {E2!r}::DOUBLE * power(sin(radians({lat})), 2))"
    return f"({math.pi / 180 * A!r}::DOUBLE * cos(radians({lat})) / sqrt({w}))", f"({math.pi / 180 * A * (1 - E2)!r}::DOUBLE / ({w} * sqrt({w})))"


def metres_to_degrees_sql(lat: str, metres: str) -> tuple[str, str]:
    half = f"({metres} / 2 / {_radii_sql(lat)[1]})"
    low, mid, high = (_radii_sql(f"({lat} + ({k}) * {half})") for k in (-1, 0, 1))
    return tuple(f"({metres} / (({a} + 4 * {b} + {c}) / 6))" for a, b, c in zip(low, mid, high, strict=True))


def bbox(lon: Column, lat: Column, x_metres: Column, y_metres: Column) -> Column:
    """struct<xmin,ymin,xmax,ymax> of full width and height around a point; NULL if it crosses the antimeridian."""
    dx, dy = metres_to_degrees(lat, x_metres)[0], metres_to_degrees(lat, y_metres)[1]
    box = F.struct((lon - dx / 2).alias("xmin"), (lat - dy / 2).alias("ymin"), (lon + dx / 2).alias("xmax"), (lat + dy / 2).alias("ymax"))
    return F.when((lon - dx / 2 >= -180) & (lon + dx / 2 <= 180) & (dx <= 180), box)


def quantised(low: Column, high: Column, grid: float = 0.01) -> tuple[Column, Column]:
    """A range snapped outward to a grid."""
    return F.floor(low / F.lit(grid)) * F.lit(grid), F.ceil(high / F.lit(grid)) * F.lit(grid)


def utm(lon: Column, lat: Column, epsg: Column) -> tuple[Column, Column]:
    """Easting and northing by the Krueger series (fourth order, under a millimetre in a zone)."""
    n = FLATTENING / (2 - FLATTENING)
    rectifying = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    e = math.sqrt(E2)
    phi, lam = F.radians(lat), F.radians(lon - ((epsg % 100) * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - F.lit(e) * F.atanh(F.lit(e) * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam)))
    x, y = eta, xi
    for j, a in enumerate(alpha, 1):
        x = x + F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    k = 0.9996 * rectifying
    return F.lit(500000.0) + F.lit(k) * x, F.when(epsg >= 32700, F.lit(1e7)).otherwise(0.0) + F.lit(k) * y


def _computed(frame: DataFrame, **columns: Column) -> DataFrame:
    """``frame`` with columns that later filters can't take apart: a predicate on a long formula would be pushed below it with
    the whole formula copied into it, once for every use.  A generator of one row is where pushing ends."""
    return frame.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def with_box(frame: DataFrame, lon: Column, lat: Column, x_metres: Column, y_metres: Column, name: str = "box") -> DataFrame:
    """``frame`` with ``bbox`` of its points; rows whose box would cross the antimeridian go."""
    dx, dy = metres_to_degrees(lat, x_metres)[0], metres_to_degrees(lat, y_metres)[1]
    own = _computed(frame, _blon=lon, _blat=lat, _dx=dx, _dy=dy)
    x, y, dx, dy = (F.col(c) for c in ("_blon", "_blat", "_dx", "_dy"))
    own = own.where((x - dx / 2 >= -180) & (x + dx / 2 <= 180) & (dx <= 180))
    box = F.struct((x - dx / 2).alias("xmin"), (y - dy / 2).alias("ymin"), (x + dx / 2).alias("xmax"), (y + dy / 2).alias("ymax"))
    return own.withColumn(name, box).drop("_blon", "_blat", "_dx", "_dy")


def with_lonlat(frame: DataFrame, x: Column, y: Column, epsg: Column, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """``frame`` with longitude and latitude of UTM coordinates (Krueger's inverse series), or of geographic ones (4326) unchanged.

    Intermediate values are columns of steps of their own, so no term of the series is computed or compiled twice.
    """
    n = FLATTENING / (2 - FLATTENING)
    rectifying = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]
    k = F.lit(0.9996 * rectifying)
    own = _computed(frame, _gx=x, _gy=y, _ge=epsg)
    own = own.withColumns({"_xi": (F.col("_gy") - F.when(F.col("_ge") >= 32700, F.lit(1e7)).otherwise(0.0)) / k, "_eta": (F.col("_gx") - F.lit(500000.0)) / k})
    a, b = F.col("_xi"), F.col("_eta")
    for j, c in enumerate(beta, 1):
        a = a - F.lit(c) * F.sin(2 * j * F.col("_xi")) * F.cosh(2 * j * F.col("_eta"))
        b = b - F.lit(c) * F.cos(2 * j * F.col("_xi")) * F.sinh(2 * j * F.col("_eta"))
    own = _computed(own, _a=a, _b=b)
    own = own.withColumn("_chi", F.asin(F.sin("_a") / F.cosh("_b")))
    up = F.col("_chi")
    for j, c in enumerate(delta, 1):
        up = up + F.lit(c) * F.sin(2 * j * F.col("_chi"))
    plain = F.col("_ge") == 4326
    east, north = (F.col("_ge") % 100) * 6 - 183 + F.degrees(F.atan2(F.sinh("_b"), F.cos("_a"))), F.degrees(up)
    own = _computed(own, **{lon: F.when(plain, F.col("_gx")).otherwise(east), lat: F.when(plain, F.col("_gy")).otherwise(north)})
    return own.drop("_xi", "_eta", "_a", "_b", "_chi", "_gx", "_gy", "_ge")


def with_xy(frame: DataFrame, lon: Column, lat: Column, epsg: Column, x: str = "x", y: str = "y") -> DataFrame:
    """``frame`` with coordinates in a UTM zone, or geographic ones (4326)."""
    own = _computed(frame, _glon=lon, _glat=lat, _ge=epsg)
    plain, moved = F.col("_ge") == 4326, utm(F.col("_glon"), F.col("_glat"), F.col("_ge"))
    return _computed(own, **{x: F.when(plain, F.col("_glon")).otherwise(moved[0]), y: F.when(plain, F.col("_glat")).otherwise(moved[1])}).drop("_glon", "_glat", "_ge")


def parallel_area(lat: Column) -> Column:
    """Square metres of the ellipsoid between the equator and a parallel, for one radian of longitude."""
    e, s = math.sqrt(E2), F.sin(F.radians(lat))
    return F.lit(A * A * (1 - E2) / 2) * (s / (1 - F.lit(E2) * s * s) + F.atanh(F.lit(e) * s) / F.lit(e))


def padded(box: Column, degrees: float = 5000 / 111320) -> Column:
    """A box (xmin, ymin, xmax, ymax) wider by so many degrees on each side, clamped to the world."""
    return F.struct(
        F.greatest(box["xmin"] - degrees, F.lit(-180.0)).alias("xmin"), F.greatest(box["ymin"] - degrees, F.lit(-90.0)).alias("ymin"),
        F.least(box["xmax"] + degrees, F.lit(180.0)).alias("xmax"), F.least(box["ymax"] + degrees, F.lit(90.0)).alias("ymax"),
    )
