"""Scene readers: one metadata model, a registry that picks by path, window and band reads; JPEG, JP2, VRT, HDF5 and NetCDF-4 need their libraries."""

from __future__ import annotations

import json
import os
import tarfile
from abc import ABC, abstractmethod
from dataclasses import asdict, dataclass, field
from datetime import datetime
from importlib.util import find_spec
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from pairloom.errors import DependencyMissingError, FormatNotSupportedError, ImageReadError, MetadataError
from pairloom.sources import codec
from pairloom.sources.products import acquisition, band_of, parse_manifest, parse_mtl


@dataclass
class Metadata:
    path: str
    driver: str
    width: int
    height: int
    band_count: int
    dtype: str
    nodata: float | None = None
    crs: str | None = None
    transform: tuple[float, ...] | None = None
    acquisition: datetime | None = None
    sensor_id: str | None = None
    band_names: list[str] = field(default_factory=list)
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.width <= 0 or self.height <= 0 or self.band_count <= 0:
            raise MetadataError("width, height and bands must be positive")
        if not self.band_names:
            self.band_names = [f"Band {k + 1}" for k in range(self.band_count)]

    @property
    def georeferenced(self) -> bool:
        return self.crs is not None and self.transform is not None

    @property
    def size_mb(self) -> float:
        return self.width * self.height * self.band_count * np.dtype(self.dtype).itemsize / 2**20

    def to_dict(self) -> dict:
        return asdict(self) | {"acquisition": self.acquisition.isoformat() if self.acquisition else None, "size_mb": self.size_mb}


class Reader(ABC):
    name, extensions, requires = "", (), ()

    def __init__(self, path: str | os.PathLike) -> None:
        self.path = str(path)
        self.metadata: Metadata | None = None

    @classmethod
    def is_available(cls) -> bool:
        return all(find_spec(m) is not None for m in cls.requires)

    @classmethod
    def can_read(cls, path: str) -> bool:
        return Path(path).suffix.lower() in cls.extensions

    @abstractmethod
    def open(self) -> Metadata: ...

    @abstractmethod
    def _window(self, bands: list[int], window: tuple[int, int, int, int]) -> np.ndarray: ...

    def read(self, bands: list[int] | None = None, window: tuple[int, int, int, int] | None = None) -> np.ndarray:
        """(bands, height, width) of 1-based bands in a window (row, col, height, width)."""
        m = self.metadata or self.open()
        bands = bands or list(range(1, m.band_count + 1))
        if any(not 1 <= b <= m.band_count for b in bands):
            raise ImageReadError(f"bands go from 1 to {m.band_count}")
        return self._window(bands, window or (0, 0, m.height, m.width))

    def __enter__(self) -> Reader:
        if self.metadata is None:
            self.open()
        return self

    def __exit__(self, *_: object) -> None: ...


class Registry:
    def __init__(self) -> None:
        self._readers: list[type[Reader]] = []

    def register(self, reader: type[Reader]) -> type[Reader]:
        if reader not in self._readers:
            self._readers.append(reader)
        return reader

    def find(self, path: str) -> type[Reader]:
        missing = None
        for r in self._readers:
            if r.can_read(path):
                if r.is_available():
                    return r
                missing = r
        if missing:
            raise DependencyMissingError(", ".join(missing.requires), missing.name)
        raise FormatNotSupportedError(path)

    def available(self) -> list[type[Reader]]:
        return [r for r in self._readers if r.is_available()]

    def report(self) -> list[dict]:
        return [{"format": r.name, "extensions": list(r.extensions), "available": r.is_available(), "requires": list(r.requires)} for r in self._readers]


registry = Registry()


def _from_layout(path: str, lay: codec.Layout, **more: object) -> Metadata:
    return Metadata(path, lay.kind, lay.width, lay.height, lay.bands, lay.dtype, lay.nodata, lay.crs, lay.transform, band_names=list(lay.names), **more)


@registry.register
class HDFReader(Reader):
    name, extensions, requires = "HDF5", (".h5", ".hdf5", ".hdf", ".he5"), ("h5py",)

    def __init__(self, path: str, dataset: str | None = None) -> None:
        super().__init__(path)
        self.dataset = dataset

    def list_datasets(self) -> list[str]:
        import h5py

        found: list[str] = []
        with h5py.File(self.path) as f:
            f.visititems(lambda n, o: found.append(n) if isinstance(o, h5py.Dataset) and o.ndim in (2, 3) else None)
        return found

    def open(self) -> Metadata:
        import h5py

        names = self.list_datasets()
        self.dataset = self.dataset or (names[0] if names else None)
        if self.dataset not in names:
            raise ImageReadError(f"no two- or three-dimensional dataset {self.dataset!r}")
        with h5py.File(self.path) as f:
            d = f[self.dataset]
            shape = d.shape if d.ndim == 3 else (1, *d.shape)
            extra = {k: v.decode("utf-8", "replace") if isinstance(v, bytes) else np.asarray(v).tolist() for k, v in d.attrs.items()}
            self.metadata = Metadata(self.path, "hdf5", shape[2], shape[1], shape[0], d.dtype.name, extra=extra)
        return self.metadata

    def _window(self, bands: list[int], window: tuple[int, int, int, int]) -> np.ndarray:
        import h5py

        r, c, h, w = window
        with h5py.File(self.path) as f:
            d = f[self.dataset]
            return d[r : r + h, c : c + w][None] if d.ndim == 2 else np.stack([d[b - 1, r : r + h, c : c + w] for b in bands])


@registry.register
class RasterReader(Reader):
    """GeoTIFF and BigTIFF, ENVI (by its header or data file)."""

    name, extensions = "Raster", (".tif", ".tiff", ".img", ".dat", ".hdr")

    def open(self) -> Metadata:
        p = Path(self.path)
        if p.suffix.lower() in (".tif", ".tiff"):
            with p.open("rb") as f:
                self._layout = codec.tiff_layout(f)
        else:
            header = p if p.suffix.lower() == ".hdr" else next((x for x in (p.with_suffix(".hdr"), Path(f"{p}.hdr")) if x.exists()), None)
            if header is None:
                raise ImageReadError(f"{p} has no ENVI header")
            self._layout = codec.envi_layout(header.read_text())
            data = [x for x in (p, *(header.with_suffix(s) for s in (".img", ".dat", "")), header.with_suffix(".bsq")) if x.suffix.lower() != ".hdr" and x.is_file()]
            if not data:
                raise ImageReadError(f"{header} has no data file")
            self._data = str(data[0])
        self.metadata = _from_layout(self.path, self._layout)
        return self.metadata

    def _window(self, bands: list[int], window: tuple[int, int, int, int]) -> np.ndarray:
        if self._layout.kind == "envi":
            return codec.envi_window(self._data, self._layout, bands, window)
        with open(self.path, "rb") as f:
            return codec.tiff_window(f, self._layout, bands, window)


@registry.register
class GdalReader(Reader):
    name, extensions, requires = "JPEG 2000 and VRT", (".jp2", ".vrt"), ("rasterio",)

    def open(self) -> Metadata:
        import rasterio

        with rasterio.open(self.path) as d:
            t = tuple(d.transform)[:6]
            self.metadata = Metadata(self.path, d.driver, d.width, d.height, d.count, d.dtypes[0], d.nodata, d.crs.to_string() if d.crs else None, None if d.transform.is_identity else t)
        return self.metadata

    def _window(self, bands: list[int], window: tuple[int, int, int, int]) -> np.ndarray:
        import rasterio
        from rasterio.windows import Window

        r, c, h, w = window
        with rasterio.open(self.path) as d:
            return d.read(bands, window=Window(c, r, w, h))


class _Banded(Reader):
    """A product of one-band files; one band is open at a time."""

    def __init__(self, path: str, band: str | None = None) -> None:
        super().__init__(path)
        self.band, self.files = band, {}

    def _open_band(self, driver: str, **more: object) -> Metadata:
        if not self.files:
            raise ImageReadError(f"{self.path} has no band files")
        self.band = self.band or min(self.files)
        if self.band not in self.files:
            raise ImageReadError(f"no band {self.band!r}; there are {sorted(self.files)}")
        self._inner = registry.find(self.files[self.band])(self.files[self.band])
        m = self._inner.open()
        extra = {"bands": sorted(self.files)} | more.pop("extra", {})
        self.metadata = Metadata(self.path, driver, m.width, m.height, 1, m.dtype, m.nodata, m.crs, m.transform, band_names=[self.band], extra=extra, **more)
        return self.metadata

    def _window(self, bands: list[int], window: tuple[int, int, int, int]) -> np.ndarray:
        return self._inner.read(bands, window)


@registry.register
class LandsatReader(_Banded):
    name, extensions = "Landsat", (".tar",)

    @classmethod
    def can_read(cls, path: str) -> bool:
        p = Path(path)
        if p.is_dir():
            return any(p.glob("*_MTL.txt"))
        return p.suffix.lower() == ".tar"

    def open(self) -> Metadata:
        p = Path(self.path)
        if p.is_dir():
            mtl = parse_mtl(sorted(p.glob("*_MTL.txt"))[0].read_text())
            files = {str(x): x.name for pattern in ("*.TIF", "*.tif") for x in sorted(p.glob(pattern))}
        else:
            target = p.with_suffix("")
            with tarfile.open(p) as tar:
                for m in tar.getmembers():
                    if not (target / m.name).resolve().is_relative_to(target.resolve()):
                        raise ImageReadError(f"{m.name} would leave {target}")
                # read in place: members of an uncompressed archive lie at fixed offsets
                names = {m.name: m for m in tar.getmembers() if m.isfile()}
                text = next((n for n in names if n.endswith("_MTL.txt")), None)
                if text is None:
                    raise ImageReadError(f"{p} holds no MTL file")
                mtl = parse_mtl(tar.extractfile(names[text]).read().decode())
                target.mkdir(exist_ok=True)
                tar.extractall(target, [m for n, m in names.items() if n.lower().endswith((".tif", "_mtl.txt"))], filter="data")
            files = {str(target / n): n for n in names if n.lower().endswith(".tif")}
        for path, name in files.items():
            self.files.setdefault(name.rsplit(".", 1)[0].rsplit("_", 1)[-1].upper(), path)
        craft = mtl.get("SPACECRAFT_ID", "")
        sensor = f"landsat{craft[-1]}" if craft[-1:].isdigit() else None
        return self._open_band("landsat", acquisition=acquisition(mtl), sensor_id=sensor, extra={"mtl": mtl})


@registry.register
class NetCDFReader(Reader):
    name, extensions = "NetCDF", (".nc", ".nc4", ".cdf")

    def __init__(self, path: str, variable: str | None = None) -> None:
        super().__init__(path)
        self.variable = variable

    def list_variables(self) -> list[str]:
        self._data = Path(self.path).read_bytes()
        self._vars = codec.netcdf_header(self._data)
        return [n for n, v in self._vars.items() if len(v["shape"]) in (2, 3)]

    def open(self) -> Metadata:
        names = self.list_variables()
        self.variable = self.variable or (names[0] if names else None)
        if self.variable not in names:
            raise ImageReadError(f"no two- or three-dimensional variable {self.variable!r}")
        v = self._vars[self.variable]
        shape = v["shape"] if len(v["shape"]) == 3 else [1, *v["shape"]]
        fill = v["attrs"].get("_FillValue")
        self.metadata = Metadata(self.path, "netcdf", shape[2], shape[1], shape[0], np.dtype(v["dtype"]).newbyteorder("=").name, fill[0] if fill else None, extra={k: x for k, x in v["attrs"].items()})
        return self.metadata

    def _window(self, bands: list[int], window: tuple[int, int, int, int]) -> np.ndarray:
        r, c, h, w = window
        a = codec.netcdf_array(self._data, self._vars[self.variable])
        a = a[None] if a.ndim == 2 else a
        return a[[b - 1 for b in bands], r : r + h, c : c + w]


@registry.register
class SafeReader(_Banded):
    name, extensions = "SAFE", (".safe",)

    @classmethod
    def can_read(cls, path: str) -> bool:
        p = Path(path)
        return p.is_dir() and (p.suffix.lower() == ".safe" or (p / "manifest.safe").exists())

    def open(self) -> Metadata:
        p = Path(self.path)
        info = parse_manifest((p / "manifest.safe").read_text()) if (p / "manifest.safe").exists() else {"files": [], "platform": None, "start": None}
        ends = (".jp2", ".tif", ".tiff")
        files = [p / f for f in info["files"] if f.lower().endswith(ends) and (p / f).exists()]
        files = files or sorted(x for x in p.rglob("*") if x.suffix.lower() in ends)
        for f in files:
            self.files.setdefault(band_of(f.name), str(f))
        start = info["start"]
        if start is None:
            for part in p.stem.split("_"):
                try:
                    start = datetime.strptime(part, "%Y%m%dT%H%M%S")
                    break
                except ValueError:
                    continue
        sensor = "sentinel1" if p.name[:3].upper().startswith("S1") else "sentinel2"
        return self._open_band("safe", acquisition=start, sensor_id=sensor, extra={"platform": info["platform"]})


@registry.register
class SimpleReader(Reader):
    """PNG and BMP; the whole image is held."""

    name, extensions = "Image", (".png", ".bmp")

    def open(self) -> Metadata:
        data = Path(self.path).read_bytes()
        self._array = codec.png_array(data) if data[:2] == b"\x89P" else codec.bmp_array(data)
        n, h, w = self._array.shape
        names = {1: ["Gray"], 3: ["Red", "Green", "Blue"], 4: ["Red", "Green", "Blue", "Alpha"]}.get(n, [])
        self.metadata = Metadata(self.path, "image", w, h, n, self._array.dtype.name, band_names=names)
        return self.metadata

    def _window(self, bands: list[int], window: tuple[int, int, int, int]) -> np.ndarray:
        r, c, h, w = window
        return self._array[[b - 1 for b in bands], r : r + h, c : c + w]


@registry.register
class JpegReader(Reader):
    name, extensions, requires = "JPEG", (".jpg", ".jpeg"), ("PIL",)

    def open(self) -> Metadata:
        from PIL import Image

        a = np.asarray(Image.open(self.path))
        self._array = a[None] if a.ndim == 2 else a.transpose(2, 0, 1)
        n, h, w = self._array.shape
        self.metadata = Metadata(self.path, "jpeg", w, h, n, a.dtype.name, band_names={1: ["Gray"], 3: ["Red", "Green", "Blue"]}.get(n, []))
        return self.metadata

    _window = SimpleReader._window


def open_image(path: str | os.PathLike, **options: str) -> Reader:
    """The first available reader that takes the path, opened."""
    reader = registry.find(str(path))(str(path), **options)
    reader.open()
    return reader


def format_report(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r["format"], r["extensions"], r["available"], r["requires"]) for r in registry.report()], "format string, extensions array<string>, available boolean, requires array<string>")


SCENES = "scene_id string, path string, driver string, width int, height int, band_count int, dtype string, nodata double, georef struct<crs:string,transform:struct<a:double,b:double,c:double,d:double,e:double,f:double>>, acquisition timestamp_ntz, sensor_id string, band_names array<string>, extra map<string,string>"


def scene_row(scene_id: str, m: Metadata) -> tuple:
    geo = (m.crs, m.transform) if m.crs or m.transform else None
    extra = {k: v if isinstance(v, str) else json.dumps(v, default=str) for k, v in m.extra.items()}
    return scene_id, m.path, m.driver, m.width, m.height, m.band_count, m.dtype, m.nodata, geo, m.acquisition, m.sensor_id, m.band_names, extra
