"""Digital numbers to reflectance, and pixel masks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Sensor:
    collection: str
    platforms: tuple[str, ...] | None
    scale: float
    offset: float
    low: int
    high: int
    mask: str | None
    mask_kind: str | None


# Collections, scaling, valid digital numbers (inclusive) and mask assets.
SENSORS = {
    "sentinel-2": Sensor("sentinel-2-l2a", None, 0.0001, 0.0, 1, 10000, "SCL", "class"),
    "landsat-8": Sensor("landsat-c2-l2", ("landsat-8", "landsat-9"), 0.0000275, -0.2, 7273, 43636, "qa_pixel", "bit"),
    "landsat-5": Sensor("landsat-c2-l2", ("landsat-5", "landsat-7"), 0.0000275, -0.2, 7273, 43636, "qa_pixel", "bit"),
    "mcd43a4": Sensor("modis-43A4-061", None, 0.0001, 0.0, 0, 32766, None, None),
}


def sensor(name: str) -> Sensor:
    if name not in SENSORS:
        raise ValueError(f"unknown source {name!r}; known: {', '.join(SENSORS)}")
    return SENSORS[name]


def reflectance(dn: Column, source: str, dn_offset: Column | int = 0) -> Column:
    """The processing offset goes first, then the range test, then the scale."""
    own, raw = sensor(source), dn - dn_offset
    return F.when(raw.between(own.low, own.high), raw * F.lit(own.scale) + F.lit(own.offset))


def baseline_offset(baseline: Column) -> Column:
    """1000 from processing baseline 4 on, 0 before, NULL if it can't be read."""
    number = baseline.try_cast("double")
    return F.when(number >= 4, 1000).when(number.isNotNull(), 0)


def clear_of_classes(mask: Column, classes: list[int]) -> Column:
    """True where a pixel belongs to none of the classes (0 to 11); an unknown class is clear."""
    if any(isinstance(c, bool) or not isinstance(c, int) or not 0 <= c <= 11 for c in classes):
        raise ValueError("classes are whole numbers from 0 to 11")
    return ~F.coalesce(mask.isin(classes), F.lit(False)) if classes else F.lit(True)


def clear_of_bits(mask: Column, bits: list[int]) -> Column:
    """True where none of the bits (0 to 15) is set."""
    if any(isinstance(b, bool) or not isinstance(b, int) or not 0 <= b <= 15 for b in bits):
        raise ValueError("bits are whole numbers from 0 to 15")
    return F.coalesce(mask.bitwiseAND(sum(1 << b for b in set(bits))) == 0, F.lit(True))
