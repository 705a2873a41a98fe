"""Planted truths, agreement with NumPy, and tile-size invariance."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.errors import CoregistrationError, RadiometricError, SARCalibrationError
from pairloom.operators import geometry, radiometry, registration, sar, stats
from pairloom.operators.geometry import Affine, Homography, ThinPlateSpline
from pairloom.operators.stencil import windows


def raster(spark, a, name="v"):
    r, c = np.indices(a.shape)
    return spark.createDataFrame(list(zip(r.ravel().tolist(), c.ravel().tolist(), a.ravel().astype(float).tolist())), f"row int, col int, {name} double")


def array(df, shape, name="v"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["row"], r["col"]] = np.nan if r[name] is None else r[name]
    return out


@pytest.fixture(scope="module")
def multiband(spark):
    rng = np.random.default_rng(1)
    ref = rng.normal(100, 20, (3, 60, 60))
    mov = 1.3 * ref + 15 + rng.normal(0, 2, ref.shape)
    mov[:, 20:30, 30:40] += 80
    rows = [([float(x) for x in a], [float(x) for x in b]) for a, b in zip(ref.reshape(3, -1).T, mov.reshape(3, -1).T)]
    return spark.createDataFrame(rows, "ref array<double>, mov array<double>").cache()


def test_moments(spark):
    x = np.random.default_rng(0).normal(size=(500, 4))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double")
    m = stats.weighted_moments(df, [F.col(k) for k in "abcd"])
    assert np.allclose(m.mean, x.mean(axis=0)) and np.allclose(m.cov, np.cov(x.T, bias=True))


def test_irmad_recovers_gain(multiband):
    m = radiometry.irmad(multiband)
    assert m.converged and all(abs(g - 1 / 1.3) < 0.05 for g in m.fit.gains)
    p = radiometry.no_change(multiband, m)
    assert p.filter("p < 0 or p > 1").count() == 0


def test_pif_recovers_gain(multiband):
    fit = radiometry.fit_pif_linear(radiometry.select_pifs(multiband))
    assert all(abs(g - 1 / 1.3) < 0.1 for g in fit.gains) and all(0 < r <= 1 for r in fit.r2)


def test_histogram_matching(spark, multiband):
    out, _ = radiometry.match_histograms(multiband)
    a = out.agg(*[F.avg(F.col(s)[0]).alias(s) for s in ("ref", "mov")]).first()
    assert abs(a["ref"] - a["mov"]) < 2
    keep = spark.createDataFrame([([1.0], [-999.0]), ([2.0], [5.0]), ([3.0], [6.0])], "ref array<double>, mov array<double>")
    assert -999.0 in [r["mov"][0] for r in radiometry.match_histograms(keep, nodata=-999.0)[0].collect()]
    flat = spark.createDataFrame([([1.0], [1.0])] * 3, "ref array<double>, mov array<double>")
    assert radiometry.match_histograms(flat)[1]["flat_bands"] == [1]


def test_normalize_pair(spark, multiband):
    assert radiometry.normalize_pair(multiband).method == "irmad"
    few = multiband.limit(5)
    got = radiometry.normalize_pair(few, method="irmad")
    assert got.method == "histogram" and got.warnings
    with pytest.raises(RadiometricError):
        radiometry.normalize_pair(few, method="magic")
    assert radiometry.chosen_method(3, 10_000, True, 10) == "histogram" and radiometry.chosen_method(1, 600, False, None) == "pif"


@pytest.mark.parametrize("size", [16, 64])
@pytest.mark.parametrize("method", ["refined_lee", "frost", "gamma_map"])
def test_speckle_any_tile_size(spark, monkeypatch, method, size):
    rng = np.random.default_rng(7)
    a = np.where(np.arange(40)[None] < 20, 0.1, 0.5) * rng.gamma(1, 1, (36, 40))
    a[5, 7] = np.nan
    from pairloom.operators import stencil

    monkeypatch.setattr(stencil.stencil, "__defaults__", (size, *stencil.stencil.__defaults__[1:]))
    got = array(sar.speckle_filter(raster(spark, a), 36, 40, method), a.shape)
    k = 7 if method == "refined_lee" else 5
    full = np.where(np.isfinite(a), a, np.nanmean(a))
    p = np.pad(full, k // 2, mode="reflect")
    want = sar.refined_lee(p, tuple(np.gradient(full)), k, 1.0) if method == "refined_lee" else sar.frost(p, k, 2.0) if method == "frost" else sar.gamma_map(p, k, 1.0)
    assert np.isnan(got[5, 7])
    got[5, 7] = want[5, 7]
    assert np.allclose(got, want, atol=1e-9)
    assert got[:, 4:16].var() < a[:, 8:16].var()


def test_frost_by_hand():
    a = np.random.default_rng(0).random((5, 5))
    mean, var = a.mean(), a.var()
    y, x = np.mgrid[:5, :5] - 2
    w = np.exp(-2 * var / mean**2 * np.hypot(y, x))
    assert sar.frost(a, 5, 2.0)[0, 0] == pytest.approx((a * w).sum() / w.sum())


def test_speckle_arguments(spark):
    df = raster(spark, np.ones((8, 8)))
    for bad in ({"method": "none"}, {"window": 4}, {"looks": -1.0}):
        with pytest.raises(SARCalibrationError):
            sar.speckle_filter(df, 8, 8, **bad)


def test_calibration(spark):
    xml = "<c><calibrationVectorList><calibrationVector><line>0</line><pixel>0 50 99</pixel><sigmaNought>500 505 510</sigmaNought></calibrationVector><calibrationVector><line>99</line><pixel>0 50 99</pixel><sigmaNought>515 520 525</sigmaNought></calibrationVector><calibrationVector><line>x</line></calibrationVector></calibrationVectorList></c>"
    lut = array(sar.calibration_lut(sar.calibration_vectors(spark, xml), 100, 100), (100, 100), "gain")
    assert lut[0, 0] == 500 and lut[99, 99] == 525 and not np.isnan(lut).any()
    with pytest.raises(SARCalibrationError):
        sar.parse_calibration_xml("<c/>")


def test_transforms():
    rng = np.random.default_rng(0)
    src = rng.random((40, 2)) * 200
    t = Affine([[1.02, 0.05, 7], [-0.03, 0.98, -4]])
    got = Affine.fit(src, t.apply(src))
    assert got.residuals(src, t.apply(src)).max() < 1e-9 and np.allclose(t.inverse_apply(t.apply(src)), src)
    h = Homography(np.array([[1.01, 0.02, 3], [0.01, 0.99, -2], [8e-4, -5e-4, 1]]))
    assert Homography.fit(src, h.apply(src)).residuals(src, h.apply(src)).max() < 1e-4
    bent = src + 3 * np.sin(src / 30)
    s = ThinPlateSpline.fit(src, bent)
    assert s.residuals(src, bent).max() < 0.1 and np.abs(s.inverse_apply(bent) - src).max() < 0.5
    assert geometry.select_transform(src, t.apply(src))[0].name == "affine"
    assert geometry.select_transform(src, h.apply(src))[0].name == "homography"
    assert geometry.select_transform(src, bent)[0].name == "tps"
    e = geometry.evaluate(src, t.apply(src))
    assert e["n_validation"] == 10 and e["target_met"]
    with pytest.raises(CoregistrationError):
        Affine.fit(src[:2], src[:2])
    with pytest.raises(CoregistrationError):
        geometry.split_matches(src[:7], src[:7])


def test_warp_resize_and_transform_columns(spark):
    a = np.arange(48.0).reshape(6, 8)
    got = array(geometry.warp(raster(spark, a), Affine([[1, 0, 2], [0, 1, -1]]), 6, 8), a.shape)
    want = np.zeros_like(a)
    want[:5, 2:] = a[1:, :6]
    assert np.allclose(got, want)
    small = array(geometry.resize(raster(spark, a), (6, 8), (3, 4)), (3, 4))
    assert np.allclose(small, a.reshape(3, 2, 4, 2).mean(axis=(1, 3)))
    src = np.random.default_rng(0).random((12, 2)) * 50
    s = ThinPlateSpline.fit(src, src + np.sin(src / 9))
    df = spark.createDataFrame([tuple(map(float, p)) for p in src + 0.3], "x double, y double")
    cols = [tuple(r) for r in df.select(*s.columns(F.col("x"), F.col("y"))).collect()]
    assert np.allclose(cols, s.apply(src + 0.3))


def test_edge_connected_any_tile_size(spark):
    m = np.zeros((20, 20), bool)
    m[0, :] = m[:, 19] = m[10, 5:20] = m[10:15, 5] = True
    m[14:18, 10:13] = True  # a hole inside
    bad = spark.createDataFrame([(int(r), int(c)) for r, c in zip(*np.nonzero(m))], "row int, col int")
    want = m.copy()
    want[14:18, 10:13] = False
    for size in (5, 64):
        got = np.zeros_like(m)
        for r in geometry.edge_connected(bad, 20, 20, size).collect():
            got[r["row"], r["col"]] = True
        assert (got == want).all()


def textured():
    rng = np.random.default_rng(0)
    y, x = np.mgrid[:200, :200]
    a = np.sin(x / 9) + np.cos(y / 7) + 4 * registration._smooth(rng.random((200, 200)), 2.5)
    for _ in range(40):
        cy, cx, s, w = rng.random(4) * (200, 200, 5, 3)
        a += w * np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / (2 * (s + 2) ** 2))
    return a


def test_registration(spark):
    a = textured()
    move = Affine([[1, 0, 5.3], [0, 1, -3.7]])
    b = registration.warp_array(a, move, a.shape)
    dx, dy, _ = registration.phase_correlation(a[20:180, 20:180], b[20:180, 20:180])
    assert abs(dx + 5.3) < 0.5 and abs(dy - 3.7) < 0.5
    pair = raster(spark, a, "ref").join(raster(spark, b, "mov"), ["row", "col"]).cache()
    gx, gy, n = registration.grid_phase_correlation(pair, 200, 200, 9)
    assert n > 0 and abs(gx + 5.3) < 0.5 and abs(gy - 3.7) < 0.5
    found = registration.register_pyramid(pair, 200, 200)
    moved = registration.warp_array(b, found.transform, a.shape)
    assert np.corrcoef(a[30:170, 30:170].ravel(), moved[30:170, 30:170].ravel())[0, 1] > 0.95
    d = np.median(found.dst - found.src, axis=0)
    assert abs(d[0] + 5.3) < 1 and abs(d[1] - 3.7) < 1 and found.evaluation()["rmse_px"] < 1
    polished = registration.ecc_refine(a, b, Affine([[1, 0, -5], [0, 1, 3.5]]))
    assert np.abs(polished.apply([[100.0, 100.0]]) - [[94.7, 103.7]]).max() < 0.2
    flat = raster(spark, np.zeros((80, 80)), "ref").withColumn("mov", F.lit(0.0))
    with pytest.raises(CoregistrationError):
        registration.register_pyramid(flat, 80, 80)


def test_windows_view():
    assert windows(np.zeros((9, 9)), 3).shape == (7, 7, 3, 3)


def test_shadows_without_clear_pixels_stay_unconfirmed(spark):
    assert geometry.HEIGHTS == (300.0, 840.0, 1380.0, 1920.0, 2460.0, 3000.0)
    clouds = spark.createDataFrame([(5, 5)], "row int, col int")
    found = {}
    for name, nir in (("none", None), ("dark", 1.0)):
        pixels = spark.createDataFrame([(r, c, nir) for r in range(10) for c in range(10)], "row int, col int, nir double")
        found[name] = {(r.row, r.col) for r in geometry.confirm_shadows(pixels, clouds, 45.0, 180.0, 600.0, geometry.HEIGHTS, 10, 10).collect()}
    # 300 / 600 rounds to the cloud itself, 3000 m lies at row 0
    assert found["none"] == found["dark"] == {(4, 5), (3, 5), (2, 5), (1, 5), (0, 5)}


def test_laplacian_skips_pixels_with_a_gap_beside(spark):
    rows = [(r, c, float(r * r + c)) for r in range(5) for c in range(5) if (r, c) != (2, 3)]
    got = {(r.row, r.col): r.lap for r in stats.laplacian(spark.createDataFrame(rows, "row int, col int, v double")).collect()}
    assert got == {(1, 1): 2.0, (1, 2): 2.0, (2, 1): 2.0, (3, 1): 2.0, (3, 2): 2.0}
