"""SAR: calibration look-up by bracketing joins, dB clipping, speckle filters as halo-tile kernels."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.errors import SARCalibrationError
from pairloom.functions.pixel import clip, finite, is_finite, stretch_uint8
from pairloom.functions.pixel import sigma0 as sigma0_of
from pairloom.operators.stencil import stencil, windows


def parse_calibration_xml(text: str) -> list[tuple[int, list[int], list[float]]]:
    """(line, pixels, gains) of every calibrationVector; malformed ones are skipped, none at all is an error."""
    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        raise SARCalibrationError(f"calibration XML can't be parsed: {e}") from e
    out = []
    for node in root.iter("calibrationVector"):
        try:
            line = int(node.findtext("line", "").strip())
            pixels = [int(x) for x in node.findtext("pixel", "").split()]
            gains = [float(x) for x in node.findtext("sigmaNought", "").split()]
        except ValueError:
            continue
        if pixels and len(pixels) == len(gains):
            out.append((line, pixels, gains))
    if not out:
        raise SARCalibrationError("no calibration vector")
    return out


def calibration_vectors(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(parse_calibration_xml(text), "line int, pixels array<int>, sigma array<double>")


def calibration_lut(vectors: DataFrame, height: int, width: int) -> DataFrame:
    """row, col, gain: interpolated along columns, then along rows, clamped at the ends.

    vectors is a scene's few dozen lines; every (line, column) knot pair is found by equality on exploded ranges, not by a range join.
    """
    checks = vectors.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("sigma")).alias("lo"), F.max(F.size("sigma")).alias("hi"), F.min(F.array_min("sigma")).alias("least"), F.bool_and(F.size("sigma") == F.size("pixels")).alias("alike")).first()
    if checks["n"] < 2 or checks["lo"] != checks["hi"] or checks["lo"] < 2 or not checks["alike"] or checks["least"] <= 0:
        raise SARCalibrationError("at least two vectors of equal size with positive gains are needed")

    def along(df: DataFrame, keys: list[str], at: str, v: str, n: int) -> DataFrame:
        """keys, at (0 to n-1), v: linear between knots."""
        w = Window.partitionBy(*keys).orderBy(at)
        first = F.row_number().over(w) == 1
        knots = df.select(*keys, F.col(at).alias("p"), F.col(v).alias("a"), F.lead(at).over(w).alias("p2"), F.lead(v).over(w).alias("a2"), first.alias("first"))
        low, high = F.when(F.col("first"), F.lit(0)).otherwise(F.col("p")), F.coalesce(F.col("p2") - 1, F.lit(n - 1))
        share = F.least(F.greatest((F.col("x") - F.col("p")) / (F.col("p2") - F.col("p")), F.lit(0.0)), F.lit(1.0))
        spans = knots.withColumn("lo", low).withColumn("hi", F.least(high, F.lit(n - 1))).filter("lo <= hi").withColumn("x", F.explode(F.sequence("lo", "hi")))
        return spans.select(*keys, F.col("x").alias(at), F.when(F.col("p2").isNull(), F.col("a")).otherwise(F.col("a") + (F.col("a2") - F.col("a")) * share).alias(v))

    points = vectors.select("line", F.explode(F.arrays_zip("pixels", "sigma")).alias("z")).select("line", F.col("z.pixels").alias("col"), F.col("z.sigma").alias("gain"))
    by_col = along(points, ["line"], "col", "gain", width).withColumnRenamed("line", "row")
    return along(by_col, ["col"], "row", "gain", height).select("row", "col", "gain")


def calibrate(pixels: DataFrame, lut: DataFrame, v: str = "v", nodata: float = 0.0) -> DataFrame:
    """pixels (row, col, v) with v as sigma nought."""
    return pixels.join(lut, ["row", "col"]).withColumn(v, sigma0_of(F.col(v), F.col("gain"), nodata)).drop("gain")


def _bounds(df: DataFrame, v: str, low: float, high: float) -> DataFrame:
    """One row: lo, hi."""
    return df.filter(is_finite(F.col(v))).agg(F.percentile(v, F.array(F.lit(low / 100), F.lit(high / 100))).alias("_p")).select(F.col("_p")[0].alias("_lo"), F.col("_p")[1].alias("_hi"))


def percentile_clip(df: DataFrame, v: str = "v", low: float = 2, high: float = 98) -> DataFrame:
    """v between its finite percentiles; missing stays."""
    if not 0 <= low < high <= 100:
        raise SARCalibrationError("percentiles must be in order, from 0 to 100")
    return df.crossJoin(F.broadcast(_bounds(df, v, low, high))).withColumn(v, clip(finite(F.col(v)), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")  # one row on the right


def stretched(df: DataFrame, v: str = "v", low: float = 2, high: float = 98) -> DataFrame:
    """v as 0 to 255 between its finite percentiles."""
    return df.crossJoin(F.broadcast(_bounds(df, v, low, high))).withColumn(v, stretch_uint8(F.col(v), F.coalesce("_lo", F.lit(0.0)), F.coalesce("_hi", F.lit(0.0)))).drop("_lo", "_hi")


def _box(padded: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    w = windows(padded, k)
    return w.mean(axis=(2, 3)), w.var(axis=(2, 3))


def box_stats(df: DataFrame, height: int, width: int, k: int) -> DataFrame:
    """row, col, mean, var (population) of the k by k window."""

    def kernel(padded: np.ndarray, block: np.ndarray, core: tuple[slice, slice]) -> dict[str, np.ndarray]:
        mean, var = _box(padded, k)
        return {"mean": mean, "var": var}

    return stencil(df, height, width, k // 2, kernel, {"mean": "double", "var": "double"})


def _half_windows(k: int) -> np.ndarray:
    """The eight half windows with their centre lines: right, left, bottom, top, and both sides of either diagonal."""
    y, x = np.mgrid[:k, :k] - k // 2
    return np.stack([side for line in (x, y, x - y, x + y) for side in (line >= 0, line <= 0)])


def refined_lee(padded: np.ndarray, gradient: tuple[np.ndarray, np.ndarray], k: int, looks: float) -> np.ndarray:
    """gradient: (down, across) at the core, of the image as it is."""
    w, cu2, half = windows(padded, k), 1.0 / looks, _half_windows(k)
    sector = ((np.arctan2(*gradient) + np.pi) / (np.pi / 4)).astype(int) % 8
    mean, var = np.empty(sector.shape), np.empty(sector.shape)
    for d in range(8):
        at = sector == d
        if at.any():
            picked = w[at][:, half[d]]
            mean[at], var[at] = picked.mean(axis=1), picked.var(axis=1)
    centre = w[:, :, k // 2, k // 2]
    cx2 = var / np.where(mean == 0, 1e-12, mean) ** 2
    gain = np.clip((cx2 - cu2) / (cx2 * (1 + cu2) + 1e-12), 0, 1)
    return mean + gain * (centre - mean)


def frost(padded: np.ndarray, k: int, damping: float) -> np.ndarray:
    w = windows(padded, k)
    y, x = np.mgrid[:k, :k] - k // 2
    mean, var = w.mean(axis=(2, 3)), w.var(axis=(2, 3))
    decay = damping * var / np.where(mean == 0, 1e-12, mean) ** 2
    weight = np.exp(-decay[..., None, None] * np.hypot(y, x))
    return (w * weight).sum(axis=(2, 3)) / weight.sum(axis=(2, 3))


def gamma_map(padded: np.ndarray, k: int, looks: float) -> np.ndarray:
    w = windows(padded, k)
    mean, var = w.mean(axis=(2, 3)), w.var(axis=(2, 3))
    centre, safe, cu = w[:, :, k // 2, k // 2], np.where(mean == 0, 1e-12, mean), 1 / np.sqrt(looks)
    cx = np.sqrt(var) / safe
    gap = cx**2 - cu**2
    alpha = (1 + cu**2) / np.where(gap <= 0, 1e-12, gap)
    b = alpha - looks - 1
    root = (b * safe + np.sqrt(np.maximum((b * safe) ** 2 + 4 * alpha * looks * safe * centre, 0))) / (2 * alpha)
    return np.where(cx >= np.sqrt(2) * cu, centre, np.where(cx > cu, root, mean))


#: name: (default window, kernel over (padded, gradient at the core, window, options)).
FILTERS: dict[str, tuple[int, Callable]] = {
    "refined_lee": (7, lambda p, g, k, o: refined_lee(p, g, k, o.get("looks", 1.0))),
    "frost": (5, lambda p, g, k, o: frost(p, k, o.get("damping", 2.0))),
    "gamma_map": (5, lambda p, g, k, o: gamma_map(p, k, o.get("looks", 1.0))),
}


def speckle_filter(df: DataFrame, height: int, width: int, method: str = "refined_lee", window: int | None = None, **options: float) -> DataFrame:
    """row, col, v filtered. Pixels that aren't finite count as the scene's mean for their neighbours and stay missing themselves."""
    if method not in FILTERS:
        raise SARCalibrationError(f"unknown speckle filter {method!r}; one of {sorted(FILTERS)}")
    k, f = FILTERS[method]
    k = window or k
    if k < 3 or k % 2 == 0 or any(o <= 0 for o in options.values()):
        raise SARCalibrationError("windows must be odd and 3 at least, options positive")
    fill = df.filter(is_finite(F.col("v"))).agg(F.coalesce(F.avg("v"), F.lit(0.0))).first()[0]

    def kernel(padded: np.ndarray, block: np.ndarray, core: tuple[slice, slice]) -> dict[str, np.ndarray]:
        own = np.where(np.isfinite(block), block, fill)
        steps = [np.gradient(own, axis=a)[core] if own.shape[a] > 1 else np.zeros_like(own)[core] for a in (0, 1)]  # one-sided at the raster's border only
        out = f(np.where(np.isfinite(padded), padded, fill), tuple(steps), k, options)
        return {"v": np.where(np.isfinite(block[core]), out, np.nan)}

    out = stencil(df, height, width, k // 2, kernel, {"v": "double"})
    return out.withColumn("v", F.when(~F.isnan("v"), F.col("v")))
