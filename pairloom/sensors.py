"""Sensor catalog: a broadcast-sized relation, and detection by file name as one CASE."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Band:
    band_id: str
    name: str
    wavelength_nm: float | None
    resolution_m: float


@dataclass(frozen=True)
class Sensor:
    sensor_id: str
    name: str
    kind: str
    resolution_m: float
    patterns: tuple[str, ...]
    rgb: tuple[str, ...] | None
    bands: tuple[Band, ...]

    def __post_init__(self) -> None:
        if self.kind not in ("optical", "sar"):
            raise ValueError(f"sensor type {self.kind!r} is neither optical nor sar")
        if self.resolution_m <= 0:
            raise ValueError("resolution must be positive")

    def band(self, band_id: str) -> Band:
        for b in self.bands:
            if b.band_id.lower() == band_id.lower():
                return b
        raise KeyError(band_id)

    def matches(self, filename: str) -> bool:
        return any(re.search(p, filename, re.IGNORECASE) for p in self.patterns)


def _sensor(sensor_id: str, name: str, kind: str, resolution: float, patterns: tuple[str, ...], rgb: str, bands: str) -> Sensor:
    """bands: id|name|wavelength|resolution, by semicolons."""
    rows = [x.strip().split("|") for x in bands.split(";")]
    return Sensor(sensor_id, name, kind, resolution, patterns, tuple(rgb.split()) or None, tuple(Band(i, n, float(w) if w else None, float(r)) for i, n, w, r in rows))


# The sensors, in registration order.
_BUILT_IN = (
    _sensor("generic", "Generic imagery", "optical", 1.0, (), "B1 B2 B3", "B1|Band 1||1; B2|Band 2||1; B3|Band 3||1"),
    _sensor("landsat5", "Landsat 5 (TM)", "optical", 30.0, (r"^LT05_", r"^LT5", r"LANDSAT[-_]?5"), "B3 B2 B1", "B1|Blue|485|30; B2|Green|560|30; B3|Red|660|30; B4|NIR|830|30; B5|SWIR 1|1650|30; B6|Thermal|11450|120; B7|SWIR 2|2215|30"),
    _sensor("landsat7", "Landsat 7 (ETM+)", "optical", 30.0, (r"^LE07_", r"^LE7", r"LANDSAT[-_]?7"), "B3 B2 B1", "B1|Blue|485|30; B2|Green|560|30; B3|Red|660|30; B4|NIR|835|30; B5|SWIR 1|1650|30; B6|Thermal|11450|60; B7|SWIR 2|2220|30; B8|Panchromatic|710|15"),
    *(
        _sensor(f"landsat{n}", f"Landsat {n} ({kind})", "optical", 30.0, (rf"^LC0{n}_", rf"^LC{n}", rf"LANDSAT[-_]?{n}"), "B4 B3 B2", "B1|Coastal aerosol|443|30; B2|Blue|482|30; B3|Green|561.5|30; B4|Red|654.5|30; B5|NIR|865|30; B6|SWIR 1|1608.5|30; B7|SWIR 2|2200.5|30; B8|Panchromatic|589.5|15; B9|Cirrus|1373.5|30; B10|Thermal 1|10895|100; B11|Thermal 2|12005|100")
        for n, kind in ((8, "OLI/TIRS"), (9, "OLI-2/TIRS-2"))
    ),
    _sensor("modis", "MODIS (Terra/Aqua)", "optical", 250.0, (r"^MOD\d{2}", r"^MYD\d{2}", r"MODIS"), "B1 B4 B3", "B1|Red|645|250; B2|NIR|858.5|250; B3|Blue|469|500; B4|Green|555|500; B5|SWIR 1|1240|500; B6|SWIR 2|1640|500; B7|SWIR 3|2130|500"),
    _sensor("planetscope", "PlanetScope (Dove)", "optical", 3.0, (r"PLANETSCOPE", r"PSScene", r"_psscene", r"\dPS[BD]?_"), "B3 B2 B1", "B1|Blue|490|3; B2|Green|565|3; B3|Red|665|3; B4|NIR|865|3"),
    _sensor("pleiades", "Pleiades 1A/1B", "optical", 2.0, (r"PHR1[AB]", r"PLEIADES"), "B2 B1 B0", "B0|Blue|490|2; B1|Green|555|2; B2|Red|650|2; B3|NIR|840|2; P|Panchromatic|650|0.5"),
    _sensor("sentinel1", "Sentinel-1 (C-SAR)", "sar", 10.0, (r"^S1[ABCD]_", r"SENTINEL[-_]?1"), "", "VV|VV polarisation||10; VH|VH polarisation||10; HH|HH polarisation||10; HV|HV polarisation||10"),
    _sensor("sentinel2", "Sentinel-2 (MSI)", "optical", 10.0, (r"^S2[ABCD]_", r"SENTINEL[-_]?2"), "B04 B03 B02", "B01|Coastal aerosol|443|60; B02|Blue|490|10; B03|Green|560|10; B04|Red|665|10; B05|Red edge 1|705|20; B06|Red edge 2|740|20; B07|Red edge 3|783|20; B08|NIR|842|10; B8A|Narrow NIR|865|20; B09|Water vapour|945|60; B10|Cirrus|1375|60; B11|SWIR 1|1610|20; B12|SWIR 2|2190|20"),
    _sensor("spot", "SPOT 6/7", "optical", 6.0, (r"SPOT[-_]?[67]", r"^SPOT"), "B2 B1 B0", "B0|Blue|485|6; B1|Green|560|6; B2|Red|660|6; B3|NIR|825|6; P|Panchromatic|625|1.5"),
    _sensor("worldview", "WorldView-2/3", "optical", 1.84, (r"WV0?[23]", r"WORLDVIEW"), "R G B", "C|Coastal|425|1.84; B|Blue|480|1.84; G|Green|545|1.84; Y|Yellow|605|1.84; R|Red|660|1.84; RE|Red edge|725|1.84; N1|NIR 1|832.5|1.84; N2|NIR 2|950|1.84; P|Panchromatic|625|0.46"),
)


class SensorCatalog:
    def __init__(self, sensors: tuple[Sensor, ...] = _BUILT_IN) -> None:
        self._by_id: dict[str, Sensor] = {}
        for s in sensors:
            self.register(s)

    def register(self, sensor: Sensor) -> None:
        if sensor.sensor_id.lower() in self._by_id:
            raise ValueError(f"sensor {sensor.sensor_id} is registered already")
        self._by_id[sensor.sensor_id.lower()] = sensor

    def ids(self) -> list[str]:
        return [s.sensor_id for s in self._by_id.values()]

    def get(self, sensor_id: str) -> Sensor:
        return self._by_id[sensor_id.lower()]

    def detect(self, path: str) -> Sensor:
        name = path.replace("\\", "/").rstrip("/").rsplit("/", 1)[-1]
        return next((s for s in self._by_id.values() if s.sensor_id != "generic" and s.matches(name)), self._by_id["generic"])

    def detect_column(self, path: Column) -> Column:
        """The first sensor, in registration order, one of whose patterns is in the base name; else generic."""
        name, out = F.regexp_extract(path, r"([^/\\]*)[/\\]*$", 1), F.lit("generic")
        for s in reversed(list(self._by_id.values())):
            if s.patterns:
                out = F.when(name.rlike("(?i)" + "|".join(f"(?:{p})" for p in s.patterns)), F.lit(s.sensor_id)).otherwise(out)
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(s.sensor_id, s.name, s.kind, s.resolution_m, list(s.patterns), list(s.rgb) if s.rgb else None, [(b.band_id, b.name, b.wavelength_nm, b.resolution_m) for b in s.bands]) for s in self._by_id.values()]
        return spark.createDataFrame(rows, "sensor_id string, name string, kind string, resolution_m double, patterns array<string>, rgb array<string>, bands array<struct<band_id:string,name:string,wavelength_nm:double,resolution_m:double>>")


catalog = SensorCatalog()
