"""One grid and one list of bands for both images of a pair."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.errors import PreprocessingError
from pairloom.operators.geometry import gather, grid, resize


@dataclass
class Side:
    """An image as a relation row, col, b (array of bands), with what is known about it."""

    pixels: DataFrame
    height: int
    width: int
    names: list[str]
    crs: str | None = None
    transform: tuple[float, ...] | None = None
    nodata: float | None = None


@dataclass
class Harmonized:
    pair: DataFrame
    height: int
    width: int
    names: list[str]
    crs: str | None
    transform: tuple[float, ...] | None
    nodata: float | None
    warnings: list[str] = field(default_factory=list)

    def to_dict(self) -> dict:
        return {"height": self.height, "width": self.width, "bands": self.names, "crs": self.crs, "transform": self.transform, "nodata": self.nodata, "warnings": self.warnings}


def band_pairs(ref: list[str], mov: list[str]) -> tuple[list[tuple[int, int]], list[str]]:
    """(0-based pairs by name, first match, upper and lower case alike; by place if no name is shared, warnings)."""
    lower = [m.lower() for m in mov]
    named = [(i, lower.index(r.lower())) for i, r in enumerate(ref) if r.lower() in lower]
    if named:
        return named, []
    n = min(len(ref), len(mov))
    return [(i, i) for i in range(n)], ["no band names in common; bands are paired by place"] + ([f"only the first {n} bands are used"] if len(ref) != len(mov) else [])


def alignment(ref: tuple[float, ...], mov: tuple[float, ...]) -> tuple[float, float, float]:
    """(x, y of the moving origin in reference pixels, ratio of pixel sizes)."""
    a, b, c, d, e, f = ref
    x, y = np.linalg.solve([[a, b], [d, e]], [mov[2] - c, mov[5] - f])
    size = lambda t: (abs(t[0]) + abs(t[1]), abs(t[3]) + abs(t[4]))
    (rx, ry), (mx, my) = size(ref), size(mov)
    return float(x), float(y), (mx / rx + my / ry) / 2


def resized(pixels: DataFrame, bands: int, old: tuple[int, int], new: tuple[int, int]) -> DataFrame:
    if old == new:
        return pixels
    out = None
    for k in range(bands):
        band = resize(pixels.select("row", "col", F.col("b")[k].alias("v")), old, new).withColumnRenamed("v", f"v{k}")
        out = band if out is None else out.join(band, ["row", "col"])
    return out.select("row", "col", F.array(*[f"v{k}" for k in range(bands)]).alias("b"))


def harmonize(ref: Side, mov: Side) -> Harmonized:
    """A pair (row, col, ref, mov): bands by name, pixel sizes alike, cropped to what both cover."""
    bands, warnings = band_pairs(ref.names, mov.names)
    names = [ref.names[i] for i, _ in bands]
    pick = lambda s, side: s.select("row", "col", F.array(*[F.col("b")[p[side]] for p in bands]).alias("b"))
    a, b = pick(ref.pixels, 0), pick(mov.pixels, 1)
    transform, height, width = ref.transform, ref.height, ref.width
    known = ref.crs and mov.crs and ref.transform and mov.transform and ref.crs.strip().upper() == mov.crs.strip().upper()
    if known:
        x, y, ratio = alignment(ref.transform, mov.transform)
        mh, mw = mov.height, mov.width
        if abs(ratio - 1) > 1e-6:
            mh, mw = max(1, round(mh * ratio)), max(1, round(mw * ratio))
            b = resized(b, len(bands), (mov.height, mov.width), (mh, mw))
            warnings.append(f"the moving image was resampled by {ratio:.4g}")
        dx, dy = round(x), round(y)
        c0, r0, c1, r1 = max(dx, 0), max(dy, 0), min(width, dx + mw), min(height, dy + mh)
        if c1 <= c0 or r1 <= r0:
            raise PreprocessingError("the images do not overlap")
        a = a.filter(F.col("row").between(r0, r1 - 1) & F.col("col").between(c0, c1 - 1)).select((F.col("row") - r0).alias("row"), (F.col("col") - c0).alias("col"), "b")
        b = b.select((F.col("row") + dy - r0).alias("row"), (F.col("col") + dx - c0).alias("col"), "b")
        height, width = r1 - r0, c1 - c0
        t = ref.transform
        transform = (t[0], t[1], t[2] + t[0] * c0 + t[1] * r0, t[3], t[4], t[5] + t[3] * c0 + t[4] * r0)
    elif (ref.height, ref.width) != (mov.height, mov.width):
        b = resized(b, len(bands), (mov.height, mov.width), (height, width))
        warnings.append("no common georeference; the moving image was resized to the reference")
    pair = a.withColumnRenamed("b", "ref").join(b.withColumnRenamed("b", "mov"), ["row", "col"])
    return Harmonized(pair, height, width, names, ref.crs, transform, ref.nodata, warnings)


RESAMPLING = ("nearest", "bilinear", "cubic")


def reproject_to_reference(mov: Side, ref: Side, method: str = "bilinear") -> DataFrame:
    """row, col, b of the moving image on the reference's grid; one CRS for both. Places outside are absent."""
    if method not in RESAMPLING:
        raise PreprocessingError(f"unknown resampling {method!r}; one of {RESAMPLING}")
    if not (ref.crs and ref.transform and mov.transform) or (mov.crs or "").strip().upper() != ref.crs.strip().upper():
        raise PreprocessingError("both images need a transform in the same CRS")
    full = lambda t: np.array([[t[0], t[1], t[2]], [t[3], t[4], t[5]], [0, 0, 1]])
    m = np.linalg.inv(full(mov.transform)) @ full(ref.transform)
    x, y = F.col("col") + 0.5, F.col("row") + 0.5
    sx, sy = float(m[0, 0]) * x + float(m[0, 1]) * y + float(m[0, 2]) - 0.5, float(m[1, 0]) * x + float(m[1, 1]) * y + float(m[1, 2]) - 0.5
    places = grid(mov.pixels.sparkSession, ref.height, ref.width).select("row", "col", sy.alias("sy"), sx.alias("sx"))
    places = places.filter(F.col("sx").between(-0.5, mov.width - 0.5) & F.col("sy").between(-0.5, mov.height - 0.5))
    clamp = lambda c, n: F.least(F.greatest(c, F.lit(0)), F.lit(n - 1))
    if method == "nearest":
        near = places.select("row", "col", clamp(F.floor(F.col("sy") + 0.5), mov.height).cast("int").alias("y"), clamp(F.floor(F.col("sx") + 0.5), mov.width).cast("int").alias("x"))
        return near.join(mov.pixels.select(F.col("row").alias("y"), F.col("col").alias("x"), "b"), ["y", "x"]).select("row", "col", "b")
    if method == "bilinear":
        inside = places.select("row", "col", clamp(F.col("sy"), mov.height).cast("double").alias("sy"), clamp(F.col("sx"), mov.width).cast("double").alias("sx"))
        out = None
        for k in range(len(mov.names)):
            band = gather(mov.pixels.select("row", "col", F.col("b")[k].alias("v")), inside).withColumnRenamed("v", f"v{k}")
            out = band if out is None else out.join(band, ["row", "col"])
        return out.select("row", "col", F.array(*[f"v{k}" for k in range(len(mov.names))]).alias("b"))

    def cubic(t):  # Keys' kernel with a = -0.5
        t = F.abs(t)
        return F.when(t <= 1, 1.5 * t * t * t - 2.5 * t * t + 1).when(t < 2, -0.5 * t * t * t + 2.5 * t * t - 4 * t + 2).otherwise(0.0)

    y0, x0 = F.floor("sy"), F.floor("sx")
    taps = F.array(*[F.struct(clamp(y0 + i, mov.height).cast("int").alias("y"), clamp(x0 + j, mov.width).cast("int").alias("x"), (cubic(F.col("sy") - y0 - i) * cubic(F.col("sx") - x0 - j)).alias("w")) for i in range(-1, 3) for j in range(-1, 3)])
    need = places.select("row", "col", F.explode(taps).alias("k")).select("row", "col", "k.*")
    got = need.join(mov.pixels.select(F.col("row").alias("y"), F.col("col").alias("x"), "b"), ["y", "x"])
    sums = [(F.sum(F.col("w") * F.col("b")[k]) / F.sum("w")).alias(f"v{k}") for k in range(len(mov.names))]
    return got.groupBy("row", "col").agg(*sums).select("row", "col", F.array(*[f"v{k}" for k in range(len(mov.names))]).alias("b"))
