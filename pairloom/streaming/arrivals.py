"""A landing folder as a stream of scenes: each micro-batch goes through the quality gate, all of its scenes in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairloom.functions import masks, pixel
from pairloom.operators import quality, tiles
from pairloom.sources import datasource
from pairloom.sources.readers import open_image


def gate(spark: SparkSession, paths: list[str], tile_size: int = 512, most: int = 16) -> DataFrame:
    """A quality row for each scene, from sampled tiles of its first band."""
    datasource.register(spark)
    out = None
    for path in paths:
        m = open_image(path).metadata
        picked = tiles.sample_tiles(tiles.tile_count(m.height, m.width, tile_size), most)
        read = spark.read.format("pairloom").option("path", path).option("tile_size", str(tile_size)).option("bands", "1").load().filter(F.col("tile_index").isin(picked))
        level = masks.TYPE_MAX.get(m.dtype)
        px = tiles.pixels_of(read).withColumn("tile_index", tiles.tile_of(F.col("row"), F.col("col"), m.width, tile_size))
        px = px.withColumn("nodata", ~pixel.is_finite(F.col("v")) | (F.lit(False) if m.nodata is None else F.col("v") == m.nodata)).withColumn("saturated", F.lit(False) if level is None else F.col("v") == level)
        out = px if out is None else out.unionByName(px)
    return quality.assess(out)


def watch(spark: SparkSession, folder: str, table: str, checkpoint: str, pattern: str = "*.tif", tile_size: int = 512) -> StreamingQuery:
    """Appends the quality rows of scenes that arrive in folder to the Parquet table; ends when all there are have been seen."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).schema("path string, modificationTime timestamp, length long, content binary").load(folder).select("path")

    def batch(df: DataFrame, number: int) -> None:
        paths = sorted(r["path"].removeprefix("file://").removeprefix("file:") for r in df.distinct().collect())  # a batch's file names
        if paths:
            gate(spark, paths, tile_size).withColumn("batch", F.lit(number)).write.mode("append").parquet(table)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
