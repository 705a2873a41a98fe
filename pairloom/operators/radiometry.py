"""Radiometric normalization of a pair: histogram matching, pseudo-invariant features, IR-MAD, and the choice between them.

The pair is a relation with the arrays ``ref`` and ``mov`` and optionally ``valid``. Passes are aggregations over it; what a
pass yields (a LUT, coefficients) is a few numbers, inlined as literals into the next plan, so lineage never grows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.errors import RadiometricError
from pairloom.functions.pixel import chi2_sf, is_finite, linear
from pairloom.operators.stats import Moments, histogram, moment_columns, moments_of

BINS = 1024
METHODS = ("histogram", "irmad", "pif")


@dataclass
class LinearFit:
    gains: list[float]
    offsets: list[float]
    n: int = 0
    r2: list[float] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


@dataclass
class IrMad:
    fit: LinearFit
    rho: np.ndarray
    a: np.ndarray
    b: np.ndarray
    mean: np.ndarray
    iterations: int
    converged: bool
    threshold: float
    warnings: list[str] = field(default_factory=list)


@dataclass
class Selection:
    method: str
    reason: str
    image: DataFrame
    details: dict
    warnings: list[str]


def valid_pixel(bands: int) -> Column:
    out = F.coalesce(F.col("valid"), F.lit(False)) if bands < 0 else F.lit(True)
    for k in range(abs(bands)):
        out = out & is_finite(F.col("ref")[k]) & is_finite(F.col("mov")[k])
    return out


def n_bands(pair: DataFrame) -> int:
    row = pair.select(F.size("ref").alias("r"), F.size("mov").alias("m")).first()
    if row is None or row["r"] != row["m"]:
        raise RadiometricError("the images of the pair have different bands")
    return row["r"]


def lut_of(ref_hist: Sequence[float], mov_hist: Sequence[float], low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """(centers, mapped): the reference value with the moving value's cumulative share."""
    r, m = np.asarray(ref_hist, float), np.asarray(mov_hist, float)
    if r.sum() <= 0 or m.sum() <= 0:
        raise RadiometricError("a histogram is empty")
    centers = low + (np.arange(len(r)) + 0.5) * (high - low) / len(r)
    return centers, np.interp(np.cumsum(m) / m.sum(), np.cumsum(r) / r.sum(), centers)


def apply_lut(x: Column, centers: np.ndarray, mapped: np.ndarray, nodata: float | None = None) -> Column:
    """Piecewise-linear through (centers, mapped), its ends clamped; nodata stays, what isn't finite becomes NULL."""
    step = float(centers[1] - centers[0]) if len(centers) > 1 else 1.0
    table = F.array(*[F.lit(float(v)) for v in mapped])
    at = F.least(F.greatest((x - float(centers[0])) / step, F.lit(0.0)), F.lit(float(len(mapped) - 1)))
    k = F.least(F.floor(at), F.lit(max(len(mapped) - 2, 0))).cast("int")
    low, high = F.get(table, k), F.coalesce(F.get(table, k + 1), F.get(table, k))
    out = F.when(is_finite(x), low + (at - k) * (high - low))
    return out if nodata is None else F.when(x == nodata, x).otherwise(out)


def match_histograms(pair: DataFrame, bins: int = BINS, nodata: float | None = None) -> tuple[DataFrame, dict]:
    """mov with each band's histogram matched to ref's: a range pass, a histogram pass, a projection."""
    n, luts = n_bands(pair), []

    def usable(x: Column) -> Column:
        return F.when(is_finite(x) if nodata is None else is_finite(x) & (x != nodata), x)

    sides = [(s, k, usable(F.col(s)[k])) for s in ("ref", "mov") for k in range(n)]
    span = pair.agg(*[f(v).alias(f"{name}_{s}{k}") for s, k, v in sides for name, f in (("lo", F.min), ("hi", F.max))]).first()
    flat = []
    for k in range(n):
        lows, highs = [span[f"lo_{s}{k}"] for s in ("ref", "mov")], [span[f"hi_{s}{k}"] for s in ("ref", "mov")]
        flat.append(None in lows or min(lows) >= max(highs))
        luts.append(None if flat[-1] else (min(lows), max(highs)))
    long = None
    for s, k, v in sides:
        if luts[k]:
            h = histogram(pair, v, *luts[k], bins).select(F.lit(s).alias("side"), F.lit(k).alias("k"), "bin", "n")
            long = h if long is None else long.unionAll(h)
    counts = {(s, k): np.zeros(bins) for s, k, _ in sides}
    for r in long.collect() if long is not None else []:  # 2 * bands * bins rows at most
        counts[r["side"], r["k"]][r["bin"]] = r["n"]
    tables = [lut_of(counts["ref", k], counts["mov", k], *luts[k]) if luts[k] else None for k in range(n)]
    bands = [apply_lut(F.col("mov")[k], *tables[k], nodata) if tables[k] else F.col("mov")[k] for k in range(n)]
    return pair.withColumn("mov", F.array(*bands)), {"bins": bins, "flat_bands": [k + 1 for k in range(n) if flat[k]]}


def pif_score(n: int) -> tuple[Column, Column]:
    """(mean relative change over the bands, mean brightness of the reference)."""
    total, bright = F.lit(0.0), F.lit(0.0)
    for k in range(n):
        r, m = F.col("ref")[k], F.col("mov")[k]
        den = F.abs(r) + F.abs(m)
        total = total + F.abs(r - m) / F.when(den == 0, F.lit(1.0)).otherwise(den)
        bright = bright + r
    return total / n, bright / n


def select_pifs(pair: DataFrame, change_at: float = 20, bright_at: float = 30) -> DataFrame:
    """pair with pif: little changed and bright enough, by percentiles over valid pixels."""
    n = n_bands(pair)
    change, bright = pif_score(n)
    valid = valid_pixel(n) & (F.coalesce(F.col("valid"), F.lit(False)) if "valid" in pair.columns else F.lit(True))
    rows = pair.withColumn("_change", change).withColumn("_bright", bright).withColumn("_ok", valid)
    marks = rows.filter("_ok").agg(F.percentile("_change", F.lit(change_at / 100)).alias("c"), F.percentile("_bright", F.lit(bright_at / 100)).alias("b")).first()
    if marks["c"] is None:
        raise RadiometricError("no valid pixel")
    pif = F.col("_ok") & (F.col("_change") <= F.lit(marks["c"])) & (F.col("_bright") >= F.lit(marks["b"]))
    return rows.withColumn("pif", pif).drop("_change", "_bright", "_ok")


def fit_linear(pair: DataFrame, where: Column) -> LinearFit:
    """Least squares of ref on mov for each band over the pixels of where; identity where mov doesn't vary."""
    n = n_bands(pair)
    stats = [F.count(F.lit(1)).alias("n")]
    for k in range(n):
        r, m = F.col("ref")[k], F.col("mov")[k]
        stats += [F.regr_slope(r, m).alias(f"g{k}"), F.regr_intercept(r, m).alias(f"o{k}"), F.var_pop(m).alias(f"v{k}")]
    row = pair.filter(where).agg(*stats).first()
    if row["n"] < 2:
        raise RadiometricError("too few pixels for a fit")
    flat = [not row[f"v{k}"] for k in range(n)]
    return LinearFit([1.0 if flat[k] else row[f"g{k}"] for k in range(n)], [0.0 if flat[k] else row[f"o{k}"] for k in range(n)], row["n"])


def fit_pif_linear(pair: DataFrame, trims: int = 2, sigma: float = 2.5) -> LinearFit:
    """Per band: trims rounds of a fit that drops residuals beyond sigma, then a last fit and its R². pair has pif."""
    n, rows = n_bands(pair), pair.filter("pif")
    count = rows.count()
    if count < 10:
        raise RadiometricError(f"{count} pseudo-invariant pixels; 10 are needed")
    bounds: list[list[tuple[float, float, float]]] = [[] for _ in range(n)]
    fit = LinearFit([1.0] * n, [0.0] * n, count, [0.0] * n)
    ref, mov = [F.col("ref")[k] for k in range(n)], [F.col("mov")[k] for k in range(n)]

    def kept(k: int) -> Column:
        out = F.lit(True)
        for g, o, limit in bounds[k]:
            out = out & (F.abs(ref[k] - (mov[k] * g + o)) <= limit)
        return out

    for step in range(trims + 1):
        stats = []
        for k in range(n):
            x, y = F.when(kept(k), mov[k]), F.when(kept(k), ref[k])
            stats += [F.regr_slope(y, x).alias(f"g{k}"), F.regr_intercept(y, x).alias(f"o{k}"), F.var_pop(x).alias(f"v{k}"), F.regr_r2(y, x).alias(f"r{k}"), F.regr_syy(y, x).alias(f"y{k}"), F.regr_count(y, x).alias(f"n{k}")]
        row = rows.agg(*stats).first()
        for k in range(n):
            if row[f"v{k}"]:
                fit.gains[k], fit.offsets[k] = row[f"g{k}"], row[f"o{k}"]
                fit.r2[k] = row[f"r{k}"] if row[f"y{k}"] else 0.0
            elif step == trims:
                fit.warnings.append(f"band {k + 1} does not vary; identity is kept")
        if step < trims:
            sds = rows.agg(*[F.stddev_pop(F.when(kept(k), ref[k] - (mov[k] * fit.gains[k] + fit.offsets[k]))).alias(f"s{k}") for k in range(n)]).first()
            for k in range(n):
                if row[f"v{k}"] and sds[f"s{k}"]:
                    bounds[k].append((fit.gains[k], fit.offsets[k], sigma * sds[f"s{k}"]))
    return fit


def cca(m: Moments, bands: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rho ascending, a, b): canonical variates of unit variance, positively correlated. Matrices of band size, on the driver."""
    ridge = 1e-9 * np.eye(bands)
    sxx, syy, sxy = m.cov[:bands, :bands] + ridge, m.cov[bands:, bands:] + ridge, m.cov[:bands, bands:]
    low = np.linalg.cholesky(sxx)
    inner = np.linalg.solve(low, sxy)
    square = inner @ np.linalg.solve(syy, inner.T)
    lam, u = np.linalg.eigh((square + square.T) / 2)
    rho = np.sqrt(np.clip(lam, 0, 1))
    a = np.linalg.solve(low.T, u)
    b = np.linalg.solve(syy, sxy.T @ a)
    a = a / np.sqrt(np.maximum(np.einsum("ik,ij,jk->k", a, sxx, a), 1e-300))
    b = b / np.sqrt(np.maximum(np.einsum("ik,ij,jk->k", b, syy, b), 1e-300))
    sign = np.where(np.einsum("ik,ij,jk->k", a, sxy, b) < 0, -1.0, 1.0)
    return rho, a, b * sign


def chi_column(a: np.ndarray, b: np.ndarray, mean: np.ndarray, rho: np.ndarray) -> Column:
    """Sum over the variates of their squared difference over its variance."""
    n, chi = len(rho), F.lit(0.0)
    for k in range(n):
        mad = F.lit(0.0)
        for i in range(n):
            mad = mad + (F.col("ref")[i] - float(mean[i])) * float(a[i, k]) - (F.col("mov")[i] - float(mean[n + i])) * float(b[i, k])
        chi = chi + mad * mad / float(max(2 * (1 - rho[k]), 1e-12))
    return chi


def _with_p(rows: DataFrame, chi: Column, n: int, name: str) -> DataFrame:
    """chi as a column of its own, so that the tail function's many uses of it don't repeat its expression."""
    return rows.withColumn("_chi", chi).withColumn(name, chi2_sf(F.col("_chi"), n)).drop("_chi")


def irmad(pair: DataFrame, rounds: int = 30, tolerance: float = 1e-4, threshold: float = 0.95) -> IrMad:
    """Each round is one aggregation over the base relation: the weights are a function of the last round's literals."""
    n = n_bands(pair)
    valid = valid_pixel(n) & (F.coalesce(F.col("valid"), F.lit(False)) if "valid" in pair.columns else F.lit(True))
    rows = pair.filter(valid).select("ref", "mov").persist()
    try:
        count = rows.count()
        if count < 10 * n:
            raise RadiometricError(f"{count} valid pixels; {10 * n} are needed")
        bands = [F.col("ref")[k] for k in range(n)] + [F.col("mov")[k] for k in range(n)]
        weighted, last, converged, step = rows.withColumn("_w", F.lit(1.0)), None, False, 0
        for step in range(1, rounds + 1):
            row = weighted.agg(*moment_columns(bands, F.col("_w"))).first()
            if row["w"] < 1e-6:
                row = rows.agg(*moment_columns(bands)).first()
            m = moments_of(row, 2 * n)
            rho, a, b = cca(m, n)
            weighted = _with_p(rows, chi_column(a, b, m.mean, rho), n, "_w")
            if last is not None and np.abs(rho - last).max() < tolerance:
                converged = True
                break
            last = rho
        # the means, and they alone, once more with the last weights
        sums = weighted.agg(F.sum("_w").alias("w"), *[F.sum(F.col("_w") * x).alias(f"s{i}") for i, x in enumerate(bands)]).first()
        mean = np.array([sums[f"s{i}"] for i in range(2 * n)]) / sums["w"] if sums["w"] >= 1e-6 else m.mean
        judged = _with_p(rows, chi_column(a, b, mean, rho), n, "_p")
        warnings = []
        if judged.filter(F.col("_p") >= threshold).count() < 10:
            threshold = 0.8
            warnings.append("fewer than 10 pixels reach the no-change threshold; 0.8 is used")
        fit = fit_linear(judged, F.col("_p") >= threshold)
        return IrMad(fit, rho, a, b, mean, step, converged, threshold, warnings)
    finally:
        rows.unpersist()


def no_change(pair: DataFrame, model: IrMad) -> DataFrame:
    """pair with chi and p, the probability of no change (0 where the pixel isn't valid)."""
    n = len(model.rho)
    valid = valid_pixel(n) & (F.coalesce(F.col("valid"), F.lit(False)) if "valid" in pair.columns else F.lit(True))
    chi = chi_column(model.a, model.b, model.mean, model.rho)
    return pair.withColumn("chi", F.when(valid, chi)).withColumn("p", F.coalesce(chi2_sf(F.col("chi"), n), F.lit(0.0)))


def apply_linear(pair: DataFrame, fit: LinearFit) -> DataFrame:
    return pair.withColumn("mov", linear(F.col("mov"), fit.gains, fit.offsets))


def choose_method(bands: Column, n_valid: Column, same_sensor: Column, gap_days: Column) -> Column:
    close = F.coalesce(same_sensor & (F.abs(gap_days) <= 30), F.lit(False))
    return F.when(close, "histogram").when((bands >= 2) & (n_valid >= 1000 * bands), "irmad").when(n_valid >= 500, "pif").otherwise("histogram")


def chosen_method(bands: int, n_valid: int, same_sensor: bool, gap_days: float | None) -> str:
    if same_sensor and gap_days is not None and abs(gap_days) <= 30:
        return "histogram"
    if bands >= 2 and n_valid >= 1000 * bands:
        return "irmad"
    return "pif" if n_valid >= 500 else "histogram"


def normalize_pair(pair: DataFrame, same_sensor: bool = False, gap_days: float | None = None, method: str | None = None) -> Selection:
    """pair with mov normalized. A method that fails falls back to histogram matching, which looks at all finite pixels."""
    if method is not None and method not in METHODS:
        raise RadiometricError(f"unknown method {method!r}; one of {METHODS}")
    n = n_bands(pair)
    valid = valid_pixel(n) & (F.coalesce(F.col("valid"), F.lit(False)) if "valid" in pair.columns else F.lit(True))
    reason = "requested"
    if method is None:
        n_valid = pair.filter(valid).count()
        method = chosen_method(n, n_valid, same_sensor, gap_days)
        reason = f"{n} bands, {n_valid} valid pixels, same sensor {same_sensor}, gap {gap_days}"
    warnings: list[str] = []
    try:
        if method == "irmad":
            model = irmad(pair)
            return Selection(method, reason, apply_linear(pair, model.fit), {"iterations": model.iterations, "converged": model.converged, "rho": model.rho.tolist(), "gains": model.fit.gains, "offsets": model.fit.offsets}, model.warnings)
        if method == "pif":
            fit = fit_pif_linear(select_pifs(pair))
            return Selection(method, reason, apply_linear(pair, fit), {"n": fit.n, "r2": fit.r2, "gains": fit.gains, "offsets": fit.offsets}, fit.warnings)
    except RadiometricError as e:
        warnings.append(f"{method} failed ({e}); histogram matching is used")
    image, details = match_histograms(pair)
    return Selection("histogram", reason, image, details, warnings)
