"""Per-pixel arithmetic. Missing is NULL; a value that isn't finite counts as missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """x, or NULL where it is NaN or infinite."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def normalized_difference(a: Column, b: Column) -> Column:
    """(a-b)/(a+b); NULL where the sum is 0."""
    return F.try_divide(a - b, a + b)


def ndsi(green: Column, swir: Column) -> Column:
    return normalized_difference(green, swir)


def ndwi(green: Column, nir: Column) -> Column:
    return normalized_difference(green, nir)


def mndwi(green: Column, swir: Column) -> Column:
    return normalized_difference(green, swir)


def to_db(x: Column, floor: float = 1e-10) -> Column:
    """10*log10 of x, or of floor if that is larger; NULL for anything that isn't finite."""
    return F.when(is_finite(x), 10 * F.log10(F.greatest(x, F.lit(floor))))


def from_db(x: Column) -> Column:
    return F.pow(F.lit(10.0), x / 10)


def sigma0(dn: Column, gain: Column, nodata: float = 0.0) -> Column:
    """dn^2/gain^2; NULL for nodata; a gain that isn't positive is an error."""
    checked = F.when(gain > 0, gain).otherwise(F.raise_error(F.lit("calibration gains must be positive")).cast("double"))
    return F.when(dn != nodata, (dn * dn) / (checked * checked))


def linear(bands: Column, gains: Sequence[float], offsets: Sequence[float]) -> Column:
    """gain*x + offset for each band of an array."""
    g, o = (F.array(*[F.lit(float(v)) for v in x]) for x in (gains, offsets))
    return F.transform(bands, lambda x, i: F.get(g, i) * x + F.get(o, i))


def clip(x: Column, low: Column | float, high: Column | float) -> Column:
    """x between low and high; NULL stays."""
    lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


def stretch_uint8(x: Column, low: Column, high: Column) -> Column:
    """0 to 255 between low and high, truncated; what isn't finite, and a flat band, gives 0."""
    scaled = (clip(finite(x), low, high) - low) / (high - low) * 255
    return F.coalesce(F.when(high > low, scaled), F.lit(0.0)).cast("int")


def chi2_sf(x: Column, df: int) -> Column:
    """Upper tail of the chi-square distribution with df degrees of freedom (closed forms for even and odd df)."""
    half, total = x / 2, F.lit(0.0)
    if df % 2 == 0:
        term = F.lit(1.0)
        for j in range(df // 2):
            term = term if j == 0 else term * half / j
            total = total + term
        return F.exp(-half) * total
    gamma = 0.8862269254527580  # Γ(3/2)
    for j in range(1, (df - 1) // 2 + 1):
        if j > 1:
            gamma *= j - 0.5
        total = total + F.pow(half, F.lit(j - 0.5)) / gamma
    return erfc(F.sqrt(half)) + F.exp(-half) * total


# Coefficients of Cody's rational approximations of the error function (Math. Comp. 23, 1969): near 0, to 4, beyond.
_NEAR_P = (3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03, 1.85777706184603153e-1)
_NEAR_Q = (2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03)
_MID_P = (5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02, 1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8)
_MID_Q = (1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03, 4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03)
_FAR_P = (3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4, 1.63153871373020978e-2)
_FAR_Q = (2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)


def _ratio(x: Column, p: tuple[float, ...], q: tuple[float, ...]) -> Column:
    """(p[-1]*x^n + p[0]*x^(n-1) + ... + p[n-1]) / (x^n + q[0]*x^(n-1) + ... + q[n-1])."""
    top, bottom = p[-1] * x, x
    for a, b in zip(p[:-2], q[:-1]):
        top, bottom = (top + a) * x, (bottom + b) * x
    return (top + p[-2]) / (bottom + q[-1])


def erfc(z: Column) -> Column:
    """Complementary error function for z >= 0."""
    square = z * z
    inverse = 1 / square
    near = 1 - z * _ratio(square, _NEAR_P, _NEAR_Q)
    mid = F.exp(-square) * _ratio(z, _MID_P, _MID_Q)
    far = F.exp(-square) * (0.5641895835477563 - inverse * _ratio(inverse, _FAR_P, _FAR_Q)) / z  # 1/sqrt(pi)
    return F.when(z <= 0.46875, near).when(z <= 4, mid).otherwise(far)


def pixel_to_coords(row: Column, col: Column, transform: Column) -> tuple[Column, Column]:
    """Map coordinates (x, y) by a transform struct a..f."""
    t = transform
    return t["a"] * col + t["b"] * row + t["c"], t["d"] * col + t["e"] * row + t["f"]


def pixel_size(transform: Column) -> tuple[Column, Column]:
    return F.abs(transform["a"]) + F.abs(transform["b"]), F.abs(transform["d"]) + F.abs(transform["e"])
