"""Tile grids, and the two shapes of a raster: tiles (binary blocks) and pixels (a row each)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TILES = "scene_id string, band int, tile_index int, row_off int, col_off int, height int, width int, dtype string, data binary, read_error string"


def tile_count(height: int, width: int, size: int) -> int:
    return -(-height // size) * -(-width // size)


def tile_grid(spark: SparkSession, height: int, width: int, size: int, overlap: int = 0) -> DataFrame:
    """tile_index, row_off, col_off, height, width: row-major, each grown by overlap and clamped to the raster."""
    if height <= 0 or width <= 0 or size <= 0 or not 0 <= overlap < size:
        raise ValueError("sizes must be positive and 0 <= overlap < size")
    across = -(-width // size)
    grid = spark.range(tile_count(height, width, size)).select(F.col("id").cast("int").alias("tile_index"), (F.col("id") / across).cast("int").alias("i"), (F.col("id") % across).cast("int").alias("j"))
    return tile_extent(grid, F.lit(height), F.lit(width), size, overlap)


def tile_extent(grid: DataFrame, height: Column, width: Column, size: int, overlap: int = 0) -> DataFrame:
    """From tile_index, i, j: the extents."""

    def span(k: Column, n: Column) -> tuple[Column, Column]:
        low = F.greatest(k * size - overlap, F.lit(0))
        return low, F.least((k + 1) * size + overlap, n) - low

    (row, h), (col, w) = span(F.col("i"), height), span(F.col("j"), width)
    return grid.select("tile_index", row.cast("int").alias("row_off"), col.cast("int").alias("col_off"), h.cast("int").alias("height"), w.cast("int").alias("width"))


def sample_tiles(total: int, most: int) -> list[int]:
    """All tile indices if they are few, else evenly spread ones."""
    return list(range(total)) if total <= most else sorted({int(k * total / most) for k in range(most)})


def tile_of(row: Column, col: Column, width: int, size: int) -> Column:
    across = -(-width // size)
    return (F.floor(row / size) * across + F.floor(col / size)).cast("int")


def pixels_of(tiles: DataFrame) -> DataFrame:
    """scene_id, row, col, band, v of tiles; unreadable tiles have no pixels."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for t in b.to_pylist():
                v = np.frombuffer(t["data"], t["dtype"]).astype(np.float64)
                r, c = np.divmod(np.arange(len(v), dtype=np.int32), np.int32(t["width"]))
                n = len(v)
                yield pa.RecordBatch.from_arrays([pa.array([t["scene_id"]] * n), pa.array(r + np.int32(t["row_off"])), pa.array(c + np.int32(t["col_off"])), pa.array(np.full(n, t["band"], np.int32)), pa.array(v)], names=["scene_id", "row", "col", "band", "v"])

    cols = ["scene_id", "band", "row_off", "col_off", "width", "dtype", "data"]
    return tiles.filter("read_error is null").select(*cols).mapInArrow(work, "scene_id string, row int, col int, band int, v double")


def banded(pixels: DataFrame, bands: int) -> DataFrame:
    """scene_id, row, col, b: the bands of each pixel as one array, by one aggregation."""
    entries = F.collect_list(F.struct("band", "v"))
    picked = F.transform(F.sequence(F.lit(1), F.lit(bands)), lambda k: F.element_at(F.map_from_entries(entries), k))
    return pixels.groupBy("scene_id", "row", "col").agg(picked.alias("b"))


def with_halo(pixels: DataFrame, height: int, width: int, size: int, halo: int) -> DataFrame:
    """pixels (row, col, ...) dealt to every tile whose extent, grown by halo, holds them: tile_index, core, then the columns.

    A pixel goes to at most four tiles as long as halo is at most the tile's edge.
    """
    if halo > size:
        raise ValueError("halo must not exceed the tile size")
    across, down = -(-width // size), -(-height // size)

    def near(x: Column, n: int) -> Column:
        own = F.floor(x / size)
        low, high = F.greatest(F.floor((x - halo) / size), F.lit(0)), F.least(F.floor((x + halo) / size), F.lit(n - 1))
        return F.sequence(F.least(low, own), F.greatest(high, own))

    spread = pixels.withColumn("_i", F.explode(near(F.col("row"), down))).withColumn("_j", F.explode(near(F.col("col"), across)))
    core = (F.col("_i") == F.floor(F.col("row") / size)) & (F.col("_j") == F.floor(F.col("col") / size))
    return spread.select((F.col("_i") * across + F.col("_j")).cast("int").alias("tile_index"), core.alias("core"), *pixels.columns)
