"""The pair pipeline: quality gate, (SAR steps), harmonization, co-registration, (masks, radiometry), with a table for each step.

A finished step leaves a Parquet table and its facts (band names, nodata, georeference, RMSE) in the work folder, so a
resumed run starts from what the interrupted one knew. The work folder must be shared by driver and executors.
"""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.errors import CoregistrationError, PipelineError
from pairloom.functions import masks, pixel
from pairloom.operators import geometry, harmonize, quality, radiometry, registration, sar, tiles
from pairloom.sources import datasource
from pairloom.sources.readers import open_image

STEPS = {"optical": ("quality", "harmonize", "coregister", "masks", "radiometry"), "sar": ("quality", "calibrate", "speckle", "harmonize", "coregister")}


@dataclass
class Step:
    name: str
    status: str
    seconds: float
    metrics: dict = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)


@dataclass
class Report:
    mode: str
    steps: list[Step] = field(default_factory=list)
    rmse_px: float | None = None
    mask_fractions: dict[str, float] = field(default_factory=dict)
    method: str | None = None
    seconds: float = 0.0
    warnings: list[str] = field(default_factory=list)

    def save(self, path: Path) -> None:
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(asdict(self), ensure_ascii=False, indent=2, default=str), "utf-8")

    def summary(self) -> str:
        lines = [f"Mode | الوضع: {self.mode}"] + [f"{s.name}: {s.status}, {s.seconds:.1f} s" for s in self.steps]
        return "\n".join([*lines, f"RMSE: {self.rmse_px if self.rmse_px is not None else '-'}", f"Seconds | الثواني: {self.seconds:.1f}"])


class PairPipeline:
    def __init__(self, spark: SparkSession, workdir: str | Path, mode: str = "optical", resume: bool = True, tile_size: int = 512, speckle: str = "refined_lee", scale: float = 1.0, target_rmse: float = 1.0) -> None:
        if mode not in STEPS:
            raise PipelineError(f"unknown mode {mode!r}; one of {sorted(STEPS)}")
        self.spark, self.work, self.mode, self.resume = spark, Path(workdir), mode, resume
        self.tile_size, self.speckle, self.scale, self.target = tile_size, speckle, scale, target_rmse
        self.state: dict = {"mode": mode, "completed": [], "facts": {}}
        self.report = Report(mode)
        datasource.register(spark)

    # --- state ---

    def _load(self) -> None:
        path = self.work / "state.json"
        if not self.resume or not path.exists():
            return
        try:
            state = json.loads(path.read_text("utf-8"))
            state["completed"], state["facts"]
        except (ValueError, KeyError, TypeError) as e:
            raise PipelineError(f"{path} is damaged: {e}") from e
        if state.get("mode") != self.mode:
            raise PipelineError(f"{path} belongs to a run in mode {state.get('mode')!r}")
        self.state = state

    def _save(self) -> None:
        self.work.mkdir(parents=True, exist_ok=True)
        part = self.work / "state.part"
        part.write_text(json.dumps(self.state, ensure_ascii=False, indent=2, default=str), "utf-8")
        part.replace(self.work / "state.json")

    def _run(self, name: str, work) -> DataFrame | None:
        """work returns (table or None, facts, metrics, warnings); a step that is done is read instead."""
        began, path = time.time(), self.work / name
        if name in self.state["completed"]:
            self.report.steps.append(Step(name, "resumed", time.time() - began, self.state["facts"][name].get("metrics", {})))
            if not self.state["facts"][name].get("table"):
                return None
            if not path.exists():
                raise PipelineError(f"the checkpoint {path} is missing")
            return self.spark.read.parquet(str(path))
        table, facts, metrics, warnings = work()
        if table is not None:
            table.write.mode("overwrite").parquet(str(path))
            table = self.spark.read.parquet(str(path))
        self.state["facts"][name] = facts | {"table": table is not None, "metrics": metrics}
        self.state["completed"].append(name)
        self._save()
        self.report.steps.append(Step(name, "completed", time.time() - began, metrics, warnings))
        self.report.warnings += warnings
        return table

    def _facts(self, name: str) -> dict:
        return self.state["facts"][name]

    # --- steps ---

    def _tiles(self, path: str, **options: object) -> DataFrame:
        return self.spark.read.format("pairloom").option("tile_size", self.tile_size).options(**{k: str(v) for k, v in options.items()}).option("path", path).load()

    def _side(self, path: str) -> harmonize.Side:
        m = open_image(path).metadata
        pixels = tiles.banded(tiles.pixels_of(self._tiles(path)), m.band_count).select("row", "col", "b")
        return harmonize.Side(pixels, m.height, m.width, m.band_names, m.crs, m.transform, m.nodata)

    def _quality(self, paths: list[str]):
        metrics, warnings, worst = {}, [], []
        for side, path in zip(("reference", "moving"), paths):
            m = open_image(path).metadata
            picked = tiles.sample_tiles(tiles.tile_count(m.height, m.width, self.tile_size), 16)
            sampled = self._tiles(path, bands=1).filter(F.col("tile_index").isin(picked))
            px = tiles.pixels_of(sampled).withColumn("tile_index", tiles.tile_of(F.col("row"), F.col("col"), m.width, self.tile_size))
            level = masks.TYPE_MAX.get(m.dtype)
            gone = ~pixel.is_finite(F.col("v")) | (F.lit(False) if m.nodata is None else F.col("v") == m.nodata)
            px = px.withColumn("nodata", gone).withColumn("saturated", F.lit(False) if level is None else F.col("v") == level)
            corrupt = sampled.groupBy("scene_id").agg(F.sum(F.col("read_error").isNotNull().cast("int")).alias("n_corrupt"))
            row = quality.assess(px, corrupt).first().asDict()
            metrics[side] = row
            if row["verdict"] == "reject":
                worst.append(side)
            elif row["verdict"] == "warn":
                warnings.append(f"the {side} image is of low quality ({row['score']:.0f})")
        if worst:
            raise PipelineError(f"rejected by the quality gate: {', '.join(worst)}", suggestion=str({s: metrics[s]["score"] for s in worst}))
        return None, {}, metrics, warnings

    def _per_band(self, side: harmonize.Side, f) -> DataFrame:
        out = None
        for k in range(len(side.names)):
            band = f(side.pixels.select("row", "col", F.col("b")[k].alias("v"))).select("row", "col", F.col("v").alias(f"v{k}"))
            out = band if out is None else out.join(band, ["row", "col"])
        return out.select("row", "col", F.array(*[f"v{k}" for k in range(len(side.names))]).alias("b"))

    def _sar(self, sides: dict[str, harmonize.Side]) -> None:
        def both(f):
            def run():
                out = None
                for name, s in sides.items():
                    t = self._per_band(s, lambda band, s=s: f(band, s)).withColumn("side", F.lit(name))
                    out = t if out is None else out.unionByName(t)
                return out, {}, {}, []

            return run

        for step, f in (
            ("calibrate", lambda band, s: sar.percentile_clip(band.withColumn("v", pixel.to_db(F.col("v"))))),
            ("speckle", lambda band, s: sar.speckle_filter(band, s.height, s.width, self.speckle)),
        ):
            table = self._run(step, both(f))
            for name, s in sides.items():
                s.pixels = table.filter(F.col("side") == name).select("row", "col", "b")

    def _coregister(self, h: dict, pair: DataFrame):
        k = geometry.pick_band(h["bands"]) - 1
        band = pair.select("row", "col", F.col("ref")[k].alias("ref"), F.col("mov")[k].alias("mov"))
        try:
            found = registration.register_pyramid(band, h["height"], h["width"])
        except CoregistrationError as e:
            return pair, {"rmse_px": None}, {"registered": False}, [f"registration failed ({e}); the images stay as they are"]
        got = found.evaluation(self.target)
        move = geometry.warp_spline if isinstance(found.transform, geometry.ThinPlateSpline) else geometry.warp
        out = pair.select("row", "col", "ref")
        n = len(h["bands"])
        for b in range(n):
            moved = move(pair.select("row", "col", F.col("mov")[b].alias("v")), found.transform, h["height"], h["width"])
            out = out.join(moved.withColumnRenamed("v", f"m{b}"), ["row", "col"])
        out = out.select("row", "col", "ref", F.array(*[f"m{b}" for b in range(n)]).alias("mov"))
        rmse = got["rmse_px"] if got else None
        warnings = found.warnings + ([f"RMSE {rmse:.2f} px is above the target"] if got and not got["target_met"] else [])
        return out, {"rmse_px": rmse}, {"registered": True, "model": found.transform.name, "method": found.method, "level": found.level, "rmse_px": rmse, "matches": len(found.src)}, warnings

    def _masks(self, h: dict, pair: DataFrame, dtype: str, roles: dict[str, int], extra: DataFrame | None, sun: tuple[float, float] | None, pixel_m: float):
        """roles: blue, green, red, nir, swir, cirrus to 1-based bands. extra: row, col and scl or qa."""
        band = {k: F.col("ref")[v - 1] for k, v in roles.items()}
        rows = pair if extra is None else pair.join(extra, ["row", "col"], "left")
        bad = masks.detect_nodata(F.col("ref"), h["nodata"]) | masks.detect_nodata(F.col("mov"), h["nodata"]) | masks.detect_saturation(F.col("ref"), dtype)
        classes = {"nodata": bad}
        have = {"scl": F.col("scl")} if "scl" in rows.columns else {"qa": F.col("qa")} if "qa" in rows.columns else {}
        if have or "blue" in band:
            classes["cloud"], decoded, _ = masks.detect_clouds(band, scale=self.scale, **have)
            classes |= {k: v for k, v in decoded.items() if k in ("shadow", "snow", "water")}
        scaled = {k: v / self.scale for k, v in band.items()}
        if "green" in band and "swir" in band and "snow" not in classes:
            classes["snow"] = masks.detect_snow(scaled["green"], scaled["swir"], scaled.get("nir"))
        if "green" in band and ({"nir", "swir"} & set(band)) and "water" not in classes:
            classes["water"] = masks.detect_water(scaled["green"], scaled.get("nir"), scaled.get("swir"))
        rows = rows.select("row", "col", "ref", "mov", *[F.coalesce(v, F.lit(False)).alias(f"is_{k}") for k, v in classes.items()])
        if sun and "cloud" in classes and "shadow" not in classes and "nir" in band:
            clear = rows.filter("not is_nodata").select("row", "col", F.col("ref")[roles["nir"] - 1].alias("nir"))
            shade = geometry.confirm_shadows(clear, rows.filter("is_cloud").select("row", "col"), *sun, pixel_m, geometry.HEIGHTS, h["height"], h["width"]).withColumn("is_shadow", F.lit(True))
            rows = rows.join(shade, ["row", "col"], "left").fillna(False, ["is_shadow"])
            classes["shadow"] = None
        code = masks.validity_code(**{k: F.col(f"is_{k}") for k in classes})
        out = rows.select("row", "col", "ref", "mov", code.alias("code"), (code == 0).alias("valid"))
        counts = {r["code"]: r["count"] for r in out.groupBy("code").count().collect()}
        total = sum(counts.values()) or 1
        fractions = {k: counts.get(v, 0) / total for k, v in masks.CODES.items()}
        low = 1 - fractions["valid"] > 0.60
        return out, {"fractions": fractions}, {"fractions": fractions, "low_reliability": low}, ["more than 60 % of the pixels are invalid"] if low else []

    def run(self, reference: str, moving: str, roles: dict[str, int] | None = None, method: str | None = None, classification: DataFrame | None = None, sun: tuple[float, float] | None = None, pixel_m: float = 10.0) -> tuple[Report, DataFrame]:
        began = time.time()
        self._load()
        ref_meta, mov_meta = open_image(reference).metadata, open_image(moving).metadata
        self._run("quality", lambda: self._quality([reference, moving]))
        sides = {"reference": self._side(reference), "moving": self._side(moving)}
        if self.mode == "sar":
            self._sar(sides)

        def harmonized():
            h = harmonize.harmonize(sides["reference"], sides["moving"])
            return h.pair, h.to_dict(), {"height": h.height, "width": h.width, "bands": len(h.names)}, h.warnings

        pair = self._run("harmonize", harmonized)
        h = self._facts("harmonize")
        pair = self._run("coregister", lambda: self._coregister(h, pair))
        self.report.rmse_px = self._facts("coregister")["rmse_px"]
        if self.mode == "optical":
            pair = self._run("masks", lambda: self._masks(h, pair, ref_meta.dtype, roles or {}, classification, sun, pixel_m))
            self.report.mask_fractions = self._facts("masks")["fractions"]

            def normalized():
                gap = (ref_meta.acquisition - mov_meta.acquisition).total_seconds() / 86400 if ref_meta.acquisition and mov_meta.acquisition else None
                same = bool(ref_meta.sensor_id and ref_meta.sensor_id == mov_meta.sensor_id)
                got = radiometry.normalize_pair(pair, same, gap, method)
                return got.image, {"method": got.method}, {"method": got.method, "reason": got.reason} | got.details, got.warnings

            pair = self._run("radiometry", normalized)
            self.report.method = self._facts("radiometry")["method"]
        self.report.seconds = time.time() - began
        self._save()
        self.report.save(self.work / "report.json")
        return self.report, pair
