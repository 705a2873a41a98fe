"""python -m pairloom.cli info | inspect PATH | preprocess REFERENCE MOVING --workdir DIR ..."""

from __future__ import annotations

import argparse
import json
import sys

from pairloom.errors import PairloomError
from pairloom.hardware import detect_hardware


def parse_roles(text: str) -> dict[str, int]:
    out = {}
    for item in filter(None, (x.strip() for x in text.split(","))):
        name, sep, band = item.partition("=")
        if not sep:
            raise ValueError(f"{item!r} is not role=band")
        out[name.strip().lower()] = int(band)
    return out


def info() -> dict:
    from pairloom.sources.readers import registry

    return {"hardware": detect_hardware().to_dict(), "formats": registry.report()}


def inspect(path: str) -> dict:
    from pairloom.sensors import catalog
    from pairloom.sources.readers import open_image

    m = open_image(path).metadata
    sensor = catalog.get(m.sensor_id) if m.sensor_id else catalog.detect(path)
    return m.to_dict() | {"sensor": {"id": sensor.sensor_id, "name": sensor.name, "type": sensor.kind, "resolution_m": sensor.resolution_m}}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pairloom")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("info").add_argument("--json", action="store_true")
    one = sub.add_parser("inspect")
    one.add_argument("path")
    one.add_argument("--json", action="store_true")
    run = sub.add_parser("preprocess")
    run.add_argument("reference")
    run.add_argument("moving")
    run.add_argument("--workdir", required=True)
    run.add_argument("--mode", choices=("optical", "sar"), default="optical")
    run.add_argument("--method", choices=("histogram", "irmad", "pif"))
    run.add_argument("--roles", type=parse_roles, default={}, help="blue=1,green=2,...")
    run.add_argument("--scale", type=float, default=1.0)
    run.add_argument("--speckle", default="refined_lee")
    run.add_argument("--tile-size", type=int, default=512)
    run.add_argument("--target-rmse", type=float, default=1.0)
    run.add_argument("--sun-elevation", type=float)
    run.add_argument("--sun-azimuth", type=float)
    run.add_argument("--pixel-size", type=float, default=10.0)
    run.add_argument("--no-resume", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        if a.command in ("info", "inspect"):
            got = info() if a.command == "info" else inspect(a.path)
            print(json.dumps(got, ensure_ascii=False, indent=2, default=str) if a.json else "\n".join(f"{k}: {v}" for k, v in got.items()))
            return 0
        from pyspark.sql import SparkSession

        from pairloom.plans.pipeline import PairPipeline

        spark = SparkSession.builder.appName("pairloom").getOrCreate()
        sun = (a.sun_elevation, a.sun_azimuth) if a.sun_elevation is not None and a.sun_azimuth is not None else None
        line = PairPipeline(spark, a.workdir, a.mode, not a.no_resume, a.tile_size, a.speckle, a.scale, a.target_rmse)
        report, _ = line.run(a.reference, a.moving, a.roles, a.method, sun=sun, pixel_m=a.pixel_size)
        print(report.summary())
        return 0
    except (PairloomError, OSError, ValueError) as e:
        print(e.bilingual() if isinstance(e, PairloomError) else e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
