"""Neighbourhood operators on halo tiles: each tile with its halo is one Arrow group, so memory is bounded by the tile."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from pairloom.operators.tiles import with_halo

#: Edge of the tiles that kernels run on.
TILE = 256


def extent(tile: int, height: int, width: int, size: int, halo: int) -> tuple[int, int, int, int, int, int, int, int]:
    """Core rows and columns of a tile, then those with its halo, clamped to the raster; ends exclusive."""
    across = -(-width // size)
    i, j = divmod(int(tile), across)
    r0, c0, r1, c1 = i * size, j * size, min((i + 1) * size, height), min((j + 1) * size, width)
    return r0, r1, c0, c1, max(r0 - halo, 0), min(r1 + halo, height), max(c0 - halo, 0), min(c1 + halo, width)


def reflected(block: np.ndarray, missing: tuple[int, int, int, int]) -> np.ndarray:
    """block continued beyond the raster's border by reflection, the edge not repeated; rasters thinner than the halo reflect again."""
    top, bottom, left, right = missing
    return np.pad(block, ((top, bottom), (left, right)), mode="reflect") if any(missing) else block


def stencil(df: DataFrame, height: int, width: int, halo: int, kernel: Callable[[np.ndarray, np.ndarray, tuple[slice, slice]], dict[str, np.ndarray]], columns: dict[str, str], size: int = TILE, keep: tuple[int, int] = (1, 1), v: str = "v") -> DataFrame:
    """row, col and the kernel's columns. df: row, col, v of one band; absent pixels are NaN.

    kernel gets (the tile with its halo, reflected at the raster's border; the same without reflection; where the core lies in
    the latter) and returns arrays of the core's shape. keep: every so many rows and columns stay, renumbered.
    """
    size = max(size, halo)
    dealt = with_halo(df.select("row", "col", v), height, width, size, halo)
    names = ["row", "col", *columns]

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, r1, c0, c1, a0, a1, b0, b1 = extent(pdf["tile_index"].iloc[0], height, width, size, halo)
        block = np.full((a1 - a0, b1 - b0), np.nan)
        block[pdf["row"].to_numpy() - a0, pdf["col"].to_numpy() - b0] = pdf[v].to_numpy(float)
        missing = (halo - (r0 - a0), halo - (a1 - r1), halo - (c0 - b0), halo - (b1 - c1))
        out = kernel(reflected(block, missing), block, (slice(r0 - a0, r1 - a0), slice(c0 - b0, c1 - b0)))
        there = np.zeros((r1 - r0, c1 - c0), bool)
        core = pdf["core"].to_numpy(bool)
        there[pdf["row"].to_numpy()[core] - r0, pdf["col"].to_numpy()[core] - c0] = True
        rows, cols = np.nonzero(there)
        stay = ((rows + r0) % keep[0] == 0) & ((cols + c0) % keep[1] == 0)
        rows, cols = rows[stay], cols[stay]
        data = {"row": (rows + r0) // keep[0], "col": (cols + c0) // keep[1]}
        return pd.DataFrame(data | {k: out[k][rows, cols] for k in columns})[names]

    schema = "row int, col int, " + ", ".join(f"{k} {t}" for k, t in columns.items())
    return dealt.groupBy("tile_index").applyInPandas(work, schema)


def windows(padded: np.ndarray, k: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(padded, (k, k))
