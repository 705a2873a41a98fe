"""Shared plumbing: tables of an input folder, the cluster's shared folder, Arrow text access."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; what is between is a word.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; set here only where it is unset."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if path is None:
        path = sc.getCheckpointDir() or tempfile.mkdtemp(prefix="pairloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/pairloom-{name}-{uuid.uuid4().hex}"


#: Shuffle files go when the table that needed them is written, and not when the driver next collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, was)


#: Rows of an Arrow batch; a batch stands in the executor's memory twice, and in the worker's.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """For rows of many KB."""
    was = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(min(rows, int(was)) if int(was) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH, was)


def saved(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cuts lineage: a Parquet table in the shared folder, read again with the same schema."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with shuffles_removed(spark):
        df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes saved tables that nothing reads any more."""
    for df in tables:
        remove(df.sparkSession, df.saved_at)


def small(df: DataFrame, rows: int) -> DataFrame:
    """A saved table, marked for broadcast if it has no more than so many rows; else Spark joins it by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fresh(name: str, *frames: DataFrame) -> str:
    """name, with underscores before it until no frame has such a column."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def hash_of_long(x: np.ndarray, seed: np.ndarray | int = 42) -> np.ndarray:
    """Spark's xxhash64 of longs; of several columns with the hash of those before as the seed."""
    h = np.uint64(seed) if isinstance(seed, int) else seed
    one, two, three, four, five = (np.uint64(k) for k in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, k: v << np.uint64(k) | v >> np.uint64(64 - k)
    h = turn((h + five + np.uint64(8)) ^ turn(x * two, 31) * one, 27) * one + four
    h = (h ^ h >> np.uint64(33)) * two
    h = (h ^ h >> np.uint64(29)) * three
    return h ^ h >> np.uint64(32)


def dealt(bucket: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[bytes]]:
    """Records (columns of fixed width) packed by bucket: the buckets, and of each the columns one after another, in the records' order."""
    order = np.argsort(bucket, kind="stable")
    at, first = np.unique(bucket[order], return_index=True)
    cols = [c[order] for c in columns]
    ends = [*first[1:], len(order)]
    return at, [b"".join(c[lo:hi].tobytes() for c in cols) for lo, hi in zip(first, ends)]


def undealt(data: bytes, kinds: list[str]) -> list[np.ndarray]:
    """The columns of one packed value."""
    n, out, at = len(data) // sum(np.dtype(k).itemsize for k in kinds), [], 0
    for k in kinds:
        out.append(np.frombuffer(data, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


#: log2 of the most 64-bit words of a bit filter.
FILTER = 21


def bits_of(keys: DataFrame) -> np.ndarray:
    """A bit filter over the hashes h: it passes all of them, and few others while they are fewer than its bits. Its size is bounded, it only spares shuffling."""
    size = 1 << min(max(int(keys.count() // 4).bit_length(), 10), FILTER)
    at = F.col("h").bitwiseAND(F.lit(size - 1).cast("long"))
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {FILTER}) & 63L as int))")
    got = keys.groupBy(at.alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(size, np.uint64)
    out[got["at"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def bits_held(keys: np.ndarray) -> np.ndarray:
    """The same filter over keys in memory."""
    out = np.zeros(1 << min(max((len(keys) // 4).bit_length(), 10), FILTER), np.uint64)
    np.bitwise_or.at(out, (keys & np.uint64(len(out) - 1)).astype(np.int64), np.uint64(1) << (keys >> np.uint64(FILTER) & np.uint64(63)))
    return out


def may_hold(bits: np.ndarray, k: np.ndarray) -> np.ndarray:
    return (bits[(k & np.uint64(len(bits) - 1)).astype(np.int64)] >> (k >> np.uint64(FILTER) & np.uint64(63)) & np.uint64(1)).astype(bool)


def with_ids_of(docs: DataFrame, ids: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, _t (the text as UTF-8) and the other columns of ids, of the documents whose doc_id is in ids (doc_id once each).

    Ids grow with the corpus, so the join shuffles at every size; a bit filter of bounded size keeps most other texts out of that.
    """
    bits = docs.sparkSession.sparkContext.broadcast(bits_of(ids.select(F.xxhash64("doc_id").alias("h"))))

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, col=2):
            on = may_hold(bits.value, b.column(0).to_numpy().view(np.uint64))
            if on.any():
                b = b.filter(pa.array(on))
                yield pa.RecordBatch.from_arrays(b.columns[1:], names=["doc_id", "_t"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    some = docs.select(F.xxhash64("doc_id").alias("h"), "doc_id", utf8(text_col).alias("_t")).mapInArrow(work, f"doc_id {kind}, _t binary")
    return some.join(ids.hint("merge"), "doc_id")


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def bytes_of(df: DataFrame) -> int:
    """Size of a saved table's files; 0 of another one."""
    if not hasattr(df, "saved_at"):
        return 0
    sc = df.sparkSession.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(df.saved_at)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_of(col: str) -> Column:
    """crc32 of an integer column written as text; null ids count as the empty string."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def utf8(col: str = "text") -> Column:
    """A text column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def binaries(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return column.to_pylist()


def trimmed() -> None:
    """Gives memory back that this worker no longer needs, as it idles beside later stages."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def batches(it: Iterator[pa.RecordBatch], max_bytes: int = 4 << 20, col: int = 1) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most about max_bytes of the binary column col (a longer row alone)."""
    for b in it:
        n = b.num_rows
        if not n:
            continue
        at = np.frombuffer(b.column(col).buffers()[1], np.int32, n + 1, offset=4 * b.column(col).offset)
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + max_bytes, "right")) - 1)
            yield b.slice(lo, hi - lo)
            lo = hi
    trimmed()


def empty_frame(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
