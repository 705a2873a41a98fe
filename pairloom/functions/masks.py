"""Class predicates of pixels, and the validity code made from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.functions.pixel import is_finite, mndwi, ndsi, ndwi

# Scene classification codes of each class.
SCL = {"nodata": (0, 1), "shadow": (3,), "water": (6,), "cloud": (8, 9, 10), "snow": (11,)}
# Quality bits of each class.
QA_BITS = {"cloud": (3, 1, 2), "shadow": (4,), "snow": (5,), "water": (7,), "nodata": (0,)}
# Validity codes.
CODES = {"valid": 0, "cloud": 1, "shadow": 2, "snow": 3, "water": 4, "nodata": 5}
#: The class that wins where several hold.
PRIORITY = ("nodata", "cloud", "shadow", "snow", "water")
#: Largest value of each integer type.
TYPE_MAX = {"uint8": 255, "int8": 127, "uint16": 65535, "int16": 32767, "uint32": 4294967295, "int32": 2147483647}


def decode_scl(scl: Column) -> dict[str, Column]:
    return {k: scl.isin(*v) for k, v in SCL.items()}


def decode_qa_pixel(qa: Column) -> dict[str, Column]:
    out = {}
    for k, bits in QA_BITS.items():
        mask = sum(1 << b for b in bits)
        out[k] = qa.cast("int").bitwiseAND(F.lit(mask)) != 0
    return out


def clouds_spectral(
    blue: Column, red: Column | None = None, nir: Column | None = None, swir: Column | None = None, cirrus: Column | None = None, scale: float = 1.0,
    blue_over: float = 0.30, bright_over: float = 0.35, ndsi_under: float = 0.8, cirrus_over: float = 0.012,
) -> Column:
    """Bright in blue and on average, not snow-like; or high in cirrus. The snow index' visible band is red, else nir, else blue."""
    seen = [x / scale for x in (blue, red, nir) if x is not None]
    total = seen[0]
    for x in seen[1:]:
        total = total + x
    out = (seen[0] > blue_over) & (total / len(seen) > bright_over)
    if swir is not None:
        visible, s = seen[1] if len(seen) > 1 else seen[0], swir / scale
        den = visible + s
        out = out & ((visible - s) / F.when(den == 0, F.lit(1.0)).otherwise(den) < ndsi_under)
    if cirrus is not None:
        out = out | (cirrus / scale > cirrus_over)
    return out


def detect_clouds(bands: dict[str, Column], scl: Column | None = None, qa: Column | None = None, scale: float = 1.0) -> tuple[Column, dict[str, Column], str]:
    """(cloud, classes of the decoded band, where it comes from): SCL before QA, with the spectral test where blue exists."""
    classes, source = (decode_scl(scl), "scl") if scl is not None else (decode_qa_pixel(qa), "qa_pixel") if qa is not None else ({}, "")
    cloud = classes.get("cloud")
    if "blue" in bands:
        spectral = clouds_spectral(bands["blue"], bands.get("red"), bands.get("nir"), bands.get("swir"), bands.get("cirrus"), scale)
        cloud, source = (spectral, "spectral") if cloud is None else (cloud | spectral, f"{source}+spectral")
    if cloud is None:
        raise ValueError("cloud detection needs a classification band, a quality band or a blue band")
    return cloud, classes, source


def detect_snow(green: Column, swir: Column, nir: Column | None = None, index_over: float = 0.40, green_over: float = 0.10, nir_over: float = 0.11) -> Column:
    index = ndsi(green, swir)
    out = is_finite(index) & (index > index_over) & (green > green_over)
    return F.coalesce(out & (nir > nir_over) if nir is not None else out, F.lit(False))


def detect_water(green: Column, nir: Column | None = None, swir: Column | None = None, over: float = 0.0) -> Column:
    if nir is None and swir is None:
        raise ValueError("water detection needs nir or swir")
    tests = [i(green, x) > over for i, x in ((ndwi, nir), (mndwi, swir)) if x is not None]
    out = F.coalesce(tests[0], F.lit(False))
    for t in tests[1:]:
        out = out | F.coalesce(t, F.lit(False))
    return out


def detect_nodata(bands: Column, value: float | None = None, all_bands: bool = False) -> Column:
    """Not finite, NULL, or the sentinel: in any band of an array, or in all."""

    def bad(x: Column) -> Column:
        gone = ~is_finite(x)
        return gone if value is None else gone | F.coalesce(x == value, F.lit(False))

    return F.forall(bands, bad) if all_bands else F.exists(bands, bad)


def detect_saturation(bands: Column, dtype: str | None = None, level: float | None = None) -> Column:
    """At the level or over it in any band; without a level (float types) nowhere."""
    level = level if level is not None else TYPE_MAX.get(dtype or "")
    return F.lit(False) if level is None else F.exists(bands, lambda x: F.coalesce(x >= level, F.lit(False)))


def validity_code(**classes: Column) -> Column:
    """The code of the first class of PRIORITY that holds, else 0."""
    out = F.lit(CODES["valid"])
    for k in reversed(PRIORITY):
        if k in classes:
            out = F.when(classes[k], F.lit(CODES[k])).otherwise(out)
    return out.cast("tinyint")
