"""Quality gate: two aggregations, tile then scene, for any number of scenes at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.stats import cloud_fraction, laplacian

REJECT, WARN = 30.0, 60.0


def tile_quality(pixels: DataFrame) -> DataFrame:
    """scene_id, tile_index, counts, blur and cloud of pixels (scene_id, tile_index, row, col, v, nodata, saturated)."""
    keys = ["scene_id", "tile_index"]
    counts = pixels.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("nodata").cast("long")).alias("n_nodata"), F.sum(F.col("saturated").cast("long")).alias("n_saturated"))
    blur = laplacian(pixels, "v", keys).groupBy(*keys).agg(F.var_pop("lap").alias("blur"))
    cloud = cloud_fraction(pixels, keys)
    return counts.join(blur, keys, "left").join(cloud, keys, "left").withColumn("blur", F.coalesce("blur", F.lit(0.0)))


def _penalty(test: Column, most: float, points: Column) -> Column:
    return F.when(test, F.least(F.lit(float(most)), points)).otherwise(0.0)


def assess(pixels: DataFrame, corrupt: DataFrame | None = None, reject: float = REJECT, warn: float = WARN) -> DataFrame:
    """A row a scene: fractions, blur, score, verdict. corrupt: scene_id, n_corrupt tiles that couldn't be read."""
    scenes = tile_quality(pixels).groupBy("scene_id").agg(
        F.count(F.lit(1)).alias("n_tiles"),
        F.coalesce(F.sum("n_nodata") / F.sum("n"), F.lit(1.0)).alias("nodata_fraction"),
        F.coalesce(F.sum("n_saturated") / F.sum("n"), F.lit(0.0)).alias("saturated_fraction"),
        F.percentile("blur", F.lit(0.5)).alias("blur"),
        F.avg("cloud").alias("cloud_fraction"),
    )
    if corrupt is None:
        scenes = scenes.withColumn("n_corrupt", F.lit(0))
    else:
        scenes = scenes.join(corrupt, "scene_id", "full_outer").fillna({"n_corrupt": 0, "n_tiles": 0, "nodata_fraction": 1.0, "saturated_fraction": 0.0, "cloud_fraction": 0.0})
    c = F.col
    sampled = c("n_tiles") + c("n_corrupt")
    points = (
        _penalty(c("n_corrupt") > 0, 40, 40 * c("n_corrupt") / sampled)
        + _penalty(c("saturated_fraction") > 0.05, 20, 200 * c("saturated_fraction"))
        + _penalty(c("nodata_fraction") > 0.30, 25, 50 * c("nodata_fraction"))
        + _penalty((c("n_tiles") > 0) & (c("blur") < 1.0), 15, F.lit(15.0))
        + _penalty(c("cloud_fraction") > 0.50, 20, 30 * c("cloud_fraction"))
    )
    score = F.when(c("n_tiles") == 0, 0.0).otherwise(F.least(F.greatest(100 - points, F.lit(0.0)), F.lit(100.0)))
    verdict = F.when(c("score") < reject, "reject").when(c("score") < warn, "warn").otherwise("proceed")
    return scenes.withColumn("score", score).withColumn("verdict", verdict)
