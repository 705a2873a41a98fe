"""Closed forms of per-pixel expressions, masks and the sensor catalog."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.errors import PairloomError, RadiometricError
from pairloom.functions import masks, pixel
from pairloom.operators import tiles
from pairloom.sensors import Band, Sensor, catalog


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first().asDict()


def test_indices_and_decibels(spark):
    lit = lambda v: F.lit(float(v))
    r = one(spark, ndsi=pixel.ndsi(lit(0.6), lit(0.1)), ndwi=pixel.ndwi(lit(0.6), lit(0.2)), zero=pixel.ndsi(lit(0), lit(0)), inf=pixel.to_db(lit("inf")), nan=pixel.to_db(lit("nan")), floor=pixel.to_db(lit(0)), s=pixel.sigma0(lit(100), lit(10)), s0=pixel.sigma0(lit(0), lit(10)))
    assert r["ndsi"] == pytest.approx(0.5 / 0.7) and r["ndwi"] == pytest.approx(0.5) and r["zero"] is None
    assert r["inf"] is None and r["nan"] is None and r["floor"] == pytest.approx(-100) and r["s"] == 100 and r["s0"] is None
    for v, db in ((0.01, -20), (0.1, -10), (1, 0), (10, 10)):
        assert one(spark, d=pixel.to_db(lit(v)), x=pixel.from_db(lit(db))) == {"d": pytest.approx(db), "x": pytest.approx(v)}


def test_gain_must_be_positive(spark):
    with pytest.raises(Exception, match="positive"):
        one(spark, s=pixel.sigma0(F.lit(1.0), F.lit(0.0)))


@pytest.mark.parametrize("df", [1, 2, 3, 4, 5, 6])
def test_chi2_tail(spark, df):
    xs = [0.01, 0.5, 1.0, 3.0, 7.5, 20.0, 60.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(pixel.chi2_sf(F.col("x"), df)).collect()]
    # numerical integration of the density
    for x, g in zip(xs, got):
        t = np.linspace(math.sqrt(x), math.sqrt(x) + 40, 400001)  # substitution u = t^2 takes the singularity away
        f = 2 * t ** (df - 1) * np.exp(-(t**2) / 2) / (2 ** (df / 2) * math.gamma(df / 2))
        assert g == pytest.approx(float(np.trapezoid(f, t)), rel=1e-6, abs=1e-12)


def test_masks(spark):
    scl = spark.createDataFrame([(k,) for k in (0, 3, 6, 8, 9, 10, 11, 4, 5)], "s int").select(*[c.alias(k) for k, c in masks.decode_scl(F.col("s")).items()]).collect()
    assert [next((k for k, v in r.asDict().items() if v), "clear") for r in scl] == ["nodata", "shadow", "water", "cloud", "cloud", "cloud", "snow", "clear", "clear"]
    qa = spark.createDataFrame([(1 << b,) for b in (3, 4, 5, 7, 0, 6)], "q int").select(*[c.alias(k) for k, c in masks.decode_qa_pixel(F.col("q")).items()]).collect()
    assert [next((k for k, v in r.asDict().items() if v), "clear") for r in qa] == ["cloud", "shadow", "snow", "water", "nodata", "clear"]
    t, f = F.lit(True), F.lit(False)
    r = one(spark, all=masks.validity_code(cloud=t, shadow=t, snow=t, water=t, nodata=t), two=masks.validity_code(cloud=t, shadow=t, snow=f), none=masks.validity_code(cloud=f))
    assert r == {"all": 5, "two": 1, "none": 0}
    b = F.array(F.lit(1.0), F.lit(float("nan")))
    r = one(spark, any=masks.detect_nodata(b), all=masks.detect_nodata(b, all_bands=True), sat=masks.detect_saturation(F.array(F.lit(255.0)), "uint8"), flt=masks.detect_saturation(F.array(F.lit(255.0)), "float32"))
    assert r == {"any": True, "all": False, "sat": True, "flt": False}
    r = one(spark, hot=masks.clouds_spectral(F.lit(0.6)), dark=masks.clouds_spectral(F.lit(0.05)), cirrus=masks.clouds_spectral(F.lit(0.05), cirrus=F.lit(0.05)))
    assert r == {"hot": True, "dark": False, "cirrus": True}
    with pytest.raises(ValueError):
        masks.detect_clouds({})


def test_tiles(spark):
    assert tiles.tile_count(100_000, 100_000, 4096) == 625
    g = tiles.tile_grid(spark, 70, 50, 32, 4).collect()
    cover = np.zeros((70, 50), int)
    for t in g:
        cover[t.row_off : t.row_off + t.height, t.col_off : t.col_off + t.width] += 1
    assert len(g) == 6 and cover.min() == 1
    for bad in ((0, 5, 2, 0), (5, 5, 2, 2), (5, 5, 0, 0)):
        with pytest.raises(ValueError):
            tiles.tile_grid(spark, *bad)
    assert tiles.sample_tiles(5, 16) == [0, 1, 2, 3, 4] and len(tiles.sample_tiles(1000, 16)) == 16


def test_sensors(spark):
    names = {"S2A_MSIL2A": "sentinel2", "LC08_L1TP": "landsat8", "LC09_x": "landsat9", "LE07_x": "landsat7", "LT05_x": "landsat5", "S1B_IW": "sentinel1", "x_PSScene": "planetscope", "PHR1B_x": "pleiades", "SPOT6_x": "spot", "WV02_x": "worldview", "MYD09": "modis", "photo.png": "generic"}
    df = spark.createDataFrame([(f"/a/b/{n}",) for n in names], "p string").select("p", catalog.detect_column(F.col("p")).alias("s"))
    assert {r.p.rsplit("/", 1)[1]: r.s for r in df.collect()} == names
    assert all(catalog.detect(f"/x/{n}").sensor_id == s for n, s in names.items())
    assert catalog.table(spark).count() == 12 and catalog.get("LANDSAT8").band("b4").name == "Red"
    with pytest.raises(ValueError):
        catalog.register(catalog.get("modis"))
    with pytest.raises(ValueError):
        Sensor("x", "x", "radio", 1.0, (), None, (Band("a", "a", None, 1.0),))


def test_errors():
    e = RadiometricError("bad", "سيئ", "try again")
    assert isinstance(e, PairloomError) and "سيئ" in e.bilingual() and "try again" in e.bilingual()
