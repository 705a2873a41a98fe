"""Sharding: minimax contiguous partition of ordered atomic groups (law ``bytes``).

Method. Equal texts are one group. Groups are ordered: first those that are heavy (at least 1/CELLS of all bytes, so
CELLS of them at most), the larger first, then the others by the hash of their text, gathered by its high bits into CELLS
atoms. The driver sees those sizes only, 2*CELLS at most whatever the input's size, binary-searches the smallest capacity
under which a greedy sweep needs no more than the shards there are, and cuts there. A group above an even share of what
is left takes a shard alone, so that it does not set the capacity for the rest.

Slots count rows within (shard, hash of the id) cells, SLOT_CELLS per shard, and add the sizes of the cells before:
no task ever holds a shard, and a hot text spreads over all cells of its shard.

Defined cases: null text counts as an empty one (no bytes); empty texts are a group; equal ids and repeated rows get
slots of their own; fewer groups than shards leave shards empty; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import saved, utf8

SHARDS = 40
OVERHEAD = 16
CELLS = 1 << 15
SLOT_CELLS = 1 << 10


def greedy(sizes: np.ndarray, ends: np.ndarray, capacity: int, most: int) -> list[int] | None:
    """First atom of each shard, filling each up to capacity; None if more than most are needed. ends: running sums."""
    cuts, at, n = [], 0, len(sizes)
    while at < n:
        if len(cuts) == most:
            return None
        cuts.append(at)
        before = int(ends[at - 1]) if at else 0
        nxt = int(np.searchsorted(ends, before + capacity, "right"))
        if nxt == at:
            return None
        at = nxt
    return cuts


def minimax_cuts(sizes: list[int] | np.ndarray, shards: int) -> tuple[list[int], int]:
    """(first atom of each shard, capacity): contiguous shards whose largest is as small as can be."""
    sizes = np.asarray(sizes, np.int64)
    if not len(sizes):
        return [], 0
    ends = np.cumsum(sizes)
    low, high = max(int(sizes.max()), -(-int(ends[-1]) // shards)), int(ends[-1])
    while low < high:
        mid = (low + high) // 2
        if greedy(sizes, ends, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return greedy(sizes, ends, low, shards), low


def plan(heavy: list[int], cells: np.ndarray, shards: int) -> tuple[list[int], np.ndarray]:
    """Shards of the heavy groups (largest first) and of the cells."""
    left, taken = sum(heavy) + int(cells.sum()), 0
    while taken < len(heavy) and shards - taken > 1 and heavy[taken] * (shards - taken) > left:
        left -= heavy[taken]
        taken += 1
    rest = np.concatenate([np.array(heavy[taken:], np.int64), np.asarray(cells, np.int64)])
    cuts, _ = minimax_cuts(rest, shards - taken)
    shard = np.searchsorted(np.array(cuts, np.int64), np.arange(len(rest)), "right") - 1 + taken
    k = len(heavy) - taken
    return [*range(taken), *map(int, shard[:k])], shard[k:]


def sharded(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, size, text_crc32, law, shard, slot, grown_shard."""
    text = utf8(text_col)
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = saved(docs.select(id_col, (F.length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), key.alias("_key")), "sizes")
    groups = saved(rows.groupBy("_key").agg(F.sum("size").alias("s")), "groups")
    total = groups.agg(F.sum("s")).first()[0] or 0
    limit = max(1, -(-total // CELLS))
    cell = F.shiftrightunsigned("_key", 64 - (CELLS.bit_length() - 1)).cast("int")
    heavy = sorted(((r["s"], r["_key"]) for r in groups.filter(F.col("s") >= limit).collect()), key=lambda x: (-x[0], x[1]))  # CELLS rows at most
    light = groups.filter(F.col("s") < limit).groupBy(cell.alias("cell")).agg(F.sum("s").alias("s")).toPandas()  # CELLS rows at most
    sizes = np.zeros(CELLS, np.int64)
    sizes[light["cell"].to_numpy(np.int64)] = light["s"].to_numpy(np.int64)
    of_heavy, of_cell = plan([s for s, _ in heavy], sizes, shards)
    spark = docs.sparkSession
    # the light groups' shards as ranges of cells, at most one for each shard
    first = [0, *(np.flatnonzero(np.diff(of_cell)) + 1).tolist()]
    by_range = F.lit(int(of_cell[0]))
    for c in first[1:]:
        by_range = F.when(cell >= c, F.lit(int(of_cell[c]))).otherwise(by_range)
    known = spark.createDataFrame([(k, s) for (_, k), s in zip(heavy, of_heavy)], "_key long, _own int")
    put = rows.join(F.broadcast(known), "_key", "left").withColumn("shard", F.coalesce("_own", by_range).cast("int"))
    put = put.withColumn("_cell", F.pmod(F.xxhash64(F.col(id_col)), F.lit(SLOT_CELLS)).cast("int"))
    counts = put.groupBy("shard", "_cell").agg(F.count(F.lit(1)).alias("n"))  # shards * SLOT_CELLS rows at most
    before = counts.select("shard", "_cell", (F.sum("n").over(Window.partitionBy("shard").orderBy("_cell")) - F.col("n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("shard", "_cell").orderBy(F.col(id_col), "_key", "size"))
    out = put.withColumn("_n", within).join(F.broadcast(before), ["shard", "_cell"])
    return out.select(
        id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_before") + F.col("_n") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
