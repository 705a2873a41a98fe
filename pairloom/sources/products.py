"""Texts that come with scenes: Landsat MTL files and SAFE manifests."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.errors import MetadataError


def parse_mtl(text: str) -> dict[str, str]:
    """KEY = VALUE lines as a flat map; of repeated keys the last holds, quotes go, groups are skipped."""
    out = {}
    for line in text.splitlines():
        key, sep, value = line.partition("=")
        key, value = key.strip(), value.strip().strip('"')
        if sep and key and key.upper() not in ("GROUP", "END_GROUP"):
            out[key] = value
    return out


def mtl_column(text: Column) -> Column:
    """The same as a map column (needs spark.sql.mapKeyDedupPolicy=LAST_WIN for repeated keys)."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: x.rlike(r"^\s*\w+\s*=") & ~x.rlike(r"(?i)^\s*(END_)?GROUP\s*="))
    return F.map_from_entries(F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^=]*)=", 1)), F.regexp_extract(x, r'=\s*"?(.*?)"?\s*$', 1))))


def acquisition(mtl: dict[str, str]) -> datetime | None:
    day, time = mtl.get("DATE_ACQUIRED"), mtl.get("SCENE_CENTER_TIME", "")
    for value, form in ((f"{day} {time.rstrip('Z').split('.')[0]}", "%Y-%m-%d %H:%M:%S"), (str(day), "%Y-%m-%d")):
        try:
            return datetime.strptime(value, form)
        except ValueError:
            continue
    return None


def acquisition_column(day: Column, time: Column) -> Column:
    full = F.try_to_timestamp(F.concat_ws(" ", day, F.regexp_extract(time, r"^([0-9:]+)", 1)), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.coalesce(full, F.try_to_timestamp(day, F.lit("yyyy-MM-dd")))


def parse_manifest(text: str) -> dict:
    """files (hrefs), platform (family and number), start (naive time) of a SAFE manifest, whatever its namespaces."""
    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        raise MetadataError(f"the manifest can't be parsed: {e}") from e
    files, platform, start, family = [], None, None, False
    for node in root.iter():
        tag, value = node.tag.rsplit("}", 1)[-1], (node.text or "").strip()
        if tag == "fileLocation" and node.get("href"):
            files.append(node.get("href").removeprefix("./"))
        elif tag == "familyName" and "sentinel" in value.lower():
            platform, family = value, True
        elif tag == "number" and family:
            platform, family = f"{platform}-{value}", False
        elif tag == "startTime" and start is None and value:
            try:
                start = datetime.fromisoformat(value.rstrip("Z"))
            except ValueError:
                pass
    return {"files": files, "platform": platform, "start": start}


_BAND = re.compile(r"_(B\d{1,2}A?|TCI|AOT|WVP|SCL)(?=[_.]|$)", re.IGNORECASE)


def band_of(filename: str) -> str:
    """Band id of a product file, else its stem."""
    stem = filename.replace("\\", "/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
    found = _BAND.search(stem)
    return found[1].upper() if found else stem
