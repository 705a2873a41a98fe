"""Masked global aggregates of pixels: moments, histograms, percentiles, least squares."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.pixel import is_finite


@dataclass
class Moments:
    weight: float
    mean: np.ndarray
    cov: np.ndarray


def moment_columns(bands: Sequence[Column], weight: Column | None = None) -> list[Column]:
    """Sums whose partial and final steps are the mergeable accumulator itself."""
    w = weight if weight is not None else F.lit(1.0)
    out = [F.sum(w).alias("w")]
    out += [F.sum(w * x).alias(f"s{i}") for i, x in enumerate(bands)]
    out += [F.sum(w * bands[i] * bands[j]).alias(f"s{i}_{j}") for i in range(len(bands)) for j in range(i, len(bands))]
    return out


def moments_of(row, n: int) -> Moments:
    w = row["w"]
    if not w:
        raise ValueError("no weight was accumulated")
    mean = np.array([row[f"s{i}"] for i in range(n)]) / w
    second = np.array([[row[f"s{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)]) / w
    return Moments(w, mean, second - np.outer(mean, mean))


def weighted_moments(df: DataFrame, bands: Sequence[Column], weight: Column | None = None) -> Moments:
    """One aggregation; population covariance."""
    return moments_of(df.agg(*moment_columns(bands, weight)).first(), len(bands))


def bin_of(v: Column, low: Column | float, high: Column | float, bins: int) -> Column:
    """0-based bin of a fixed range, its right edge closed; NULL outside."""
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    return F.when((v >= lo) & (v <= hi), F.least(F.floor((v - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int"))


def histogram(df: DataFrame, v: Column, low: float, high: float, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """keys, bin, n of finite values within the range."""
    b = bin_of(F.when(is_finite(v), v), low, high, bins)
    return df.select(*keys, b.alias("bin")).filter("bin is not null").groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))


def cdf(hist: DataFrame) -> DataFrame:
    """bin, n, cum of one small histogram."""
    return hist.withColumn("cum", F.sum("n").over(Window.orderBy("bin")))


def laplacian(df: DataFrame, v: str = "v", keys: Sequence[str] = ()) -> DataFrame:
    """The 4-neighbour Laplacian at pixels (row, col) with all four neighbours, by two window passes over rows and columns."""
    along = Window.partitionBy(*keys, "row").orderBy("col")
    down = Window.partitionBy(*keys, "col").orderBy("row")

    def beside(step, at: str, window) -> Column:
        """The next value there is, if no pixel is missing between."""
        return F.when(F.abs(step(at).over(window) - F.col(at)) == 1, step(v).over(window))

    near = [beside(step, at, window) for at, window in (("col", along), ("row", down)) for step in (F.lag, F.lead)]
    value = near[0] + near[1] + near[2] + near[3] - 4 * F.col(v)
    return df.withColumn("lap", value).filter("lap is not null")


def cloud_fraction(df: DataFrame, keys: Sequence[str], v: str = "v", share: float = 0.85) -> DataFrame:
    """keys, cloud: share of values above p1 + share*(p99 - p1) of their group; flat groups 0. Two aggregations."""
    p = F.percentile(F.col(v), F.array(F.lit(0.01), F.lit(0.99)))
    marks = df.groupBy(*keys).agg(p.alias("_p"))
    high = F.col("_p")[0] + share * (F.col("_p")[1] - F.col("_p")[0])
    flat = F.col("_p")[1] <= F.col("_p")[0]
    rows = df.join(marks, list(keys)) if keys else df.crossJoin(F.broadcast(marks))
    return rows.groupBy(*keys).agg(F.avg(F.when(flat, 0.0).otherwise((F.col(v) > high).cast("double"))).alias("cloud"))


def ols(y: Column, x: Column) -> tuple[Column, Column]:
    """(gain, offset) of y on x; identity where x doesn't vary."""
    varies = F.var_pop(x) > 0
    return F.when(varies, F.regr_slope(y, x)).otherwise(F.lit(1.0)), F.when(varies, F.regr_intercept(y, x)).otherwise(F.lit(0.0))
