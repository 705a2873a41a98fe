"""Round trips through the codecs, readers, the data source, the pair pipeline and the stream."""

import json
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom import cli
from pairloom.config import SettingsFile
from pairloom.errors import ConfigError, DependencyMissingError, FormatNotSupportedError, ImageReadError, ImageWriteError, PipelineError, PreprocessingError
from pairloom.hardware import classify_tier
from pairloom.operators import harmonize, tiles
from pairloom.operators.geometry import Affine
from pairloom.operators.registration import _smooth, warp_array
from pairloom.plans.pipeline import PairPipeline
from pairloom.sources import codec, datasource, products, sinks
from pairloom.sources.readers import open_image
from pairloom.streaming import arrivals

GEO = (10.0, 0.0, 500000.0, 0.0, -10.0, 4100000.0)
MTL = 'GROUP = L1\n SPACECRAFT_ID = "LANDSAT_8"\n DATE_ACQUIRED = 2024-02-20\n SCENE_CENTER_TIME = "08:15:32.0250000Z"\n CLOUD_COVER = 3.12\n CLOUD_COVER = 4\nEND_GROUP = L1\nEND\n'
MANIFEST = '<x:XFDU xmlns:x="u" xmlns:s="v"><s:startTime>2024-01-15T08:33:01.024Z</s:startTime><s:familyName>SENTINEL</s:familyName><s:number>2A</s:number><fileLocation href="./IMG/T_B02.tif"/><fileLocation href="./IMG/T_B03.tif"/></x:XFDU>'


@pytest.mark.parametrize("dtype", ["uint8", "uint16", "int16", "int32", "float32", "float64"])
@pytest.mark.parametrize("compress", [None, "deflate"])
def test_tiff(tmp_path, dtype, compress):
    a = (np.random.default_rng(7).random((2, 300, 70)) * 200).astype(dtype)
    sinks.write_geotiff(tmp_path / "d" / "a.tif", a, "EPSG:32636", GEO, 0, compress)
    r = open_image(tmp_path / "d" / "a.tif")
    assert (r.read() == a).all() and (r.read([2], (290, 60, 10, 10)) == a[1:, 290:, 60:]).all()
    assert (r.metadata.crs, r.metadata.transform, r.metadata.nodata) == ("EPSG:32636", GEO, 0) and r.metadata.georeferenced
    with pytest.raises(ImageReadError):
        r.read([3])


def test_lzw_and_packbits():
    # codes 256, 65, 66, 258, 257 in nine bits each
    bits = "".join(f"{c:09b}" for c in (256, 65, 66, 258, 257)).ljust(48, "0")
    assert codec._unlzw(bytes(int(bits[k : k + 8], 2) for k in range(0, 48, 8))) == b"ABAB"
    assert codec._unpackbits(bytes([2, 1, 2, 3, 254, 9])) == bytes([1, 2, 3, 9, 9, 9])


@pytest.mark.parametrize("bands,dtype", [(1, "uint8"), (3, "uint8"), (4, "uint8"), (1, "uint16"), (3, "uint16")])
def test_png(tmp_path, bands, dtype):
    a = (np.random.default_rng(42).random((bands, 32, 48)) * np.iinfo(dtype).max).astype(dtype)
    (tmp_path / "a.png").write_bytes(codec.png_bytes(a))
    assert (open_image(tmp_path / "a.png").read() == a).all()


def test_export_png(tmp_path):
    sinks.export_png(tmp_path / "a.png", np.random.default_rng(0).random((2, 9, 9)))
    assert open_image(tmp_path / "a.png").metadata.band_count == 1
    assert not sinks.stretch(np.ones((4, 4))).any() and sinks.stretch(np.array([[300.0, -1]]), None).tolist() == [[255, 0]]
    with pytest.raises(ImageWriteError):
        sinks.write_geotiff(tmp_path / "x.tif", np.zeros((1, 1, 1, 1)))


def test_envi_and_netcdf(tmp_path):
    a = np.arange(24, dtype="<i2").reshape(2, 3, 4)
    (tmp_path / "e.img").write_bytes(a.tobytes())
    (tmp_path / "e.hdr").write_text("ENVI\nsamples = 4\nlines = 3\nbands = 2\ndata type = 2\ninterleave = bsq\nbyte order = 0\nband names = {Red, NIR}\nmap info = {UTM, 1, 1, 500000, 4100000, 10, 10, 36, North}\n")
    r = open_image(tmp_path / "e.img")
    assert (r.read() == a).all() and r.metadata.band_names == ["Red", "NIR"] and r.metadata.crs == "EPSG:32636" and r.metadata.transform == GEO
    name = lambda s: len(s).to_bytes(4, "big") + s.encode().ljust(-(-len(s) // 4) * 4, b"\0")
    n = lambda *v: b"".join(x.to_bytes(4, "big") for x in v)
    head = b"CDF\x01" + n(0) + n(10, 2) + name("y") + n(2) + name("x") + n(3) + n(0, 0) + n(11, 1) + name("temp") + n(2, 0, 1) + n(0, 0) + n(5, 24)
    data = np.arange(6, dtype=">f4")
    (tmp_path / "t.nc").write_bytes(head + n(len(head) + 4) + data.tobytes())
    r = open_image(tmp_path / "t.nc")
    assert r.list_variables() == ["temp"] and (r.read()[0] == data.reshape(2, 3)).all()


def test_products(tmp_path, spark):
    for b, seed in (("B4", 21), ("B5", 22)):
        sinks.write_geotiff(tmp_path / "L" / f"LC08_{b}.TIF", np.random.default_rng(seed).integers(0, 9999, (12, 14)).astype("uint16"), "EPSG:32636", GEO)
    (tmp_path / "L" / "LC08_MTL.txt").write_text(MTL)
    r = open_image(tmp_path / "L")
    assert r.metadata.sensor_id == "landsat8" and r.metadata.band_names == ["B4"] and str(r.metadata.acquisition) == "2024-02-20 08:15:32" and r.read().shape == (1, 12, 14)
    with tarfile.open(tmp_path / "L.tar", "w") as t:
        for f in (tmp_path / "L").iterdir():
            t.add(f, f.name)
    (tmp_path / "t").mkdir()
    (tmp_path / "L.tar").rename(tmp_path / "t" / "L.tar")
    assert open_image(tmp_path / "t" / "L.tar", band="B5").metadata.band_names == ["B5"]
    assert products.parse_mtl(MTL)["CLOUD_COVER"] == "4"
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    row = spark.createDataFrame([(MTL,)], "t string").select(products.mtl_column(F.col("t")).alias("m")).select("m", products.acquisition_column(F.col("m")["DATE_ACQUIRED"], F.col("m")["SCENE_CENTER_TIME"]).alias("at")).first()
    assert row["m"] == products.parse_mtl(MTL) and str(row["at"]) == "2024-02-20 08:15:32"
    safe = tmp_path / "S2A_x.SAFE"
    for b in ("B02", "B03"):
        sinks.write_geotiff(safe / "IMG" / f"T_{b}.tif", np.ones((5, 5), "uint16"))
    (safe / "manifest.safe").write_text(MANIFEST)
    m = open_image(safe).metadata
    assert (m.sensor_id, m.band_names, m.extra["bands"], m.extra["platform"]) == ("sentinel2", ["B02"], ["B02", "B03"], "SENTINEL-2A") and m.acquisition.year == 2024


def test_registry_errors(tmp_path):
    with pytest.raises(FormatNotSupportedError):
        open_image(tmp_path / "x.doc")
    with pytest.raises(DependencyMissingError):
        open_image(tmp_path / "x.h5")


def test_data_source(spark, tmp_path):
    a = np.random.default_rng(0).integers(0, 4095, (2, 70, 90)).astype("uint16")
    sinks.write_geotiff(tmp_path / "a.tif", a)
    datasource.register(spark)
    df = spark.read.format("pairloom").option("path", str(tmp_path / "a.tif")).option("tile_size", "32").load()
    assert df.count() == 2 * 9
    assert df.filter("tile_index in (0, 4)").count() == 4
    got = np.zeros_like(a, float)
    for r in tiles.pixels_of(df).collect():
        got[r["band"] - 1, r["row"], r["col"]] = r["v"]
    assert (got == a).all()
    assert tiles.banded(tiles.pixels_of(df), 2).filter("row = 3 and col = 5").first()["b"] == [float(a[0, 3, 5]), float(a[1, 3, 5])]
    (tmp_path / "a.tif").write_bytes((tmp_path / "a.tif").read_bytes()[:0] + b"II*\0" + b"\0" * 4)
    with pytest.raises(Exception):
        df.count()


def side(spark, a, transform=None, crs=None, names=("Red",)):
    rows = [(r, c, [float(x) for x in a[:, r, c]]) for r in range(a.shape[1]) for c in range(a.shape[2])]
    return harmonize.Side(spark.createDataFrame(rows, "row int, col int, b array<double>"), a.shape[1], a.shape[2], list(names), crs, transform)


def test_harmonize(spark):
    a = np.arange(1600.0).reshape(1, 40, 40)
    moved = (10.0, 0.0, 500100.0, 0.0, -10.0, 4099950.0)
    h = harmonize.harmonize(side(spark, a, GEO, "EPSG:32636"), side(spark, a, moved, "epsg:32636 "))
    assert (h.height, h.width, h.transform) == (35, 30, moved) and h.pair.count() == 35 * 30
    r = h.pair.filter("row = 2 and col = 3").first()
    assert r["ref"][0] == a[0, 7, 13] and r["mov"][0] == a[0, 2, 3]
    h = harmonize.harmonize(side(spark, a, GEO, "EPSG:32636"), side(spark, a[:, ::2, ::2], (20.0, 0.0, 500000.0, 0.0, -20.0, 4100000.0), "EPSG:32636"))
    assert (h.height, h.width) == (40, 40) and h.warnings and h.pair.count() == 1600
    with pytest.raises(PreprocessingError):
        harmonize.harmonize(side(spark, a, GEO, "EPSG:32636"), side(spark, a, (10.0, 0.0, 900000.0, 0.0, -10.0, 4100000.0), "EPSG:32636"))
    for how in harmonize.RESAMPLING:
        got = harmonize.reproject_to_reference(side(spark, a, GEO, "EPSG:32636"), side(spark, a, moved, "EPSG:32636"), how)
        assert got.filter("row = 2 and col = 3").first()["b"][0] == pytest.approx(a[0, 7, 13])
    assert harmonize.band_pairs(["Red", "NIR"], ["nir", "blue"]) == ([(1, 0)], [])


@pytest.fixture(scope="module")
def images(tmp_path_factory):
    d = tmp_path_factory.mktemp("pair")
    base = _smooth(np.random.default_rng(3).random((160, 160)), 2.5)
    base = (base - base.min()) / (base.max() - base.min())
    ref = np.stack([base * k for k in (200, 180, 220)])
    mov = np.stack([warp_array(b, Affine([[1, 0, 4], [0, 1, -2.5]]), b.shape) for b in ref])
    for name, a in (("ref", ref), ("mov", mov)):
        (d / f"{name}.png").write_bytes(codec.png_bytes(a.astype(np.uint8)))
    return str(d / "ref.png"), str(d / "mov.png")


def test_pair_pipeline(spark, tmp_path, images):
    report, out = PairPipeline(spark, tmp_path / "w").run(*images)
    assert [s.status for s in report.steps] == ["completed"] * 5 and report.rmse_px < 1 and out.count() > 0
    again, _ = PairPipeline(spark, tmp_path / "w").run(*images)
    assert [s.status for s in again.steps] == ["resumed"] * 5 and again.rmse_px == report.rmse_px and again.mask_fractions == report.mask_fractions
    assert json.loads((tmp_path / "w" / "report.json").read_text())["mode"] == "optical"
    with pytest.raises(PipelineError):
        PairPipeline(spark, tmp_path / "w", "sar").run(*images)
    (tmp_path / "w" / "state.json").write_text("{")
    with pytest.raises(PipelineError):
        PairPipeline(spark, tmp_path / "w").run(*images)


def test_stream_and_cli(spark, tmp_path, images, capsys):
    a = np.random.default_rng(0).integers(0, 4000, (1, 80, 80)).astype("uint16")
    for k in range(2):
        sinks.write_geotiff(tmp_path / "in" / f"s{k}.tif", a)
    q = arrivals.watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert cli.main(["inspect", images[0], "--json"]) == 0 and json.loads(capsys.readouterr().out)["band_count"] == 3
    assert cli.main(["info", "--json"]) == 0 and cli.main(["inspect", "missing.doc"]) == 1
    assert cli.parse_roles("Blue=1, nir=4") == {"blue": 1, "nir": 4}
    with pytest.raises(ValueError):
        cli.parse_roles("blue")


def test_settings_and_tiers(tmp_path):
    f = SettingsFile(tmp_path / "c.json")
    assert f.load().language == "en" and f.update(theme="light").theme == "light"
    for k in range(25):
        f.opened(f"f{k}")
    assert f.opened("f3").recent_files[:2] == ["f3", "f24"] and len(f.load().recent_files) == 20
    with pytest.raises(ConfigError):
        f.update(nothing=1)
    (tmp_path / "c.json").write_text('{"language": "xx"}')
    with pytest.raises(ConfigError):
        f.load()
    tiers = {(2, 16000, False): "LOW", (4, 6000, False): "MEDIUM", (8, 16000, False): "HIGH", (16, 65536, True): "WORKSTATION", (16, 65536, False): "HIGH"}
    assert all(classify_tier(*k) == v for k, v in tiers.items())
