"""Token-id output as a content-addressed store, read back by recipe.

Format. ``chunks``: one row for each distinct chunk: chunk (BLAKE2b-128 of its bytes) and ids (a byte that tells their
width, then little-endian 16-bit ids, or 32-bit ones where the vocabulary needs them). ``recipes``: one row a document in ascending doc_id order, in
files of ranges: doc_id, part, row, start within the part, n_tokens, and refs (16 bytes of chunk, 4 bytes of length each).
``recipes`` also hold one manifest row a part: its document and token counts, its first and last id, and the Merkle root
over its recipes' digests.

Chunks are cut where a rolling hash of the last WINDOW ids has MASK's bits clear, so equal passages give equal chunks
wherever they stand; a chunk has MOST ids at most. Writing shuffles each task's distinct chunks once, by content, and
the small recipes once evenly (copies of a text are spread) and once by range of doc_id; texts and whole id streams never move.
Tables go through Spark's own committer into the shared folder, so a lost executor's tasks run again without a trace.

Reading verifies every chunk against its name, every part against its Merkle root and every length, then finds each
document's crc32 from those of its chunks (crc32 is linear), so chunk contents needn't be joined back. References meet
their chunks by shuffle; chunks with a share of 1/FREQUENT of all references, FREQUENT at most, are broadcast.

Memory: texts are taken in slices of SLICE bytes, a task remembers MET chunk names at most (forgotten ones are dropped by the
shuffle), and Merkle roots are folded.

Defined cases: null text is an empty document, which is its end id; repeated rows and ids are stored as documents of their
own, equal ids in the order of their contents; a null id comes first; an empty table gives empty tables.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import batches, parts, saved, scratch, shuffles_removed, utf8
from pairloom.llm.encoding import WORD_BPE, encoder

END_ID = 1
WINDOW = 8
MASK = (1 << 8) - 1
LEAST, MOST = 32, 2048
DIGEST = 16
SLICE, MET = 2 << 20, 50_000
FREQUENT = 1 << 14
STAGED = "key binary, doc_id {id}, ids binary, kind int"
CHUNK, RECIPE, MANIFEST = 0, 1, 2


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def marks(ids: np.ndarray) -> np.ndarray:
    """Places after which the rolling hash asks for a cut. Streams may follow one another: a stream's first LEAST places, where the window holds the one before, aren't used."""
    mixed = ids.astype(np.uint32) * np.uint32(2654435761)
    mixed ^= mixed >> np.uint32(15)
    roll = np.zeros(len(ids), np.uint32)
    for k in range(min(WINDOW, len(ids))):
        roll[k:] += mixed[: len(ids) - k] * np.uint32(pow(0x01000193, k, 1 << 32))
    roll ^= roll >> np.uint32(16)
    return np.flatnonzero((roll & np.uint32(MASK)) == 0) + 1


def ends_of(asked: list[int], n: int) -> list[int]:
    """Ends of the chunks of a stream of n ids, given its marks."""
    out, last = [], 0
    for c in asked:
        while c - last > MOST:
            last += MOST
            out.append(last)
        if c - last >= LEAST:
            out.append(c)
            last = c
    while n - last > MOST:
        last += MOST
        out.append(last)
    if last < n:
        out.append(n)
    return out


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream."""
    return ends_of(marks(ids).tolist(), len(ids))


NARROW = bytes([2])


def pack_ids(ids: np.ndarray) -> bytes:
    """A leading byte tells the width."""
    wide = len(ids) and int(ids.max()) >= 1 << 16
    return bytes([4]) + ids.astype("<u4").tobytes() if wide else NARROW + ids.astype("<u2").tobytes()


def unpack_ids(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4" if data[0] == 4 else "<u2", offset=1).astype("<u4")


def _staged(docs: DataFrame, file: str) -> DataFrame:
    """Each task's distinct chunks, and a recipe of each document; slot: of a chunk by its name, of recipes evenly."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end, met, spread = encoder(file), np.array([END_ID], "<u4").tobytes(), set(), 7919 * TaskContext.get().partitionId()
        for b in batches(it, SLICE):
            keys, ids_of, data, kinds, slots = [], [], [], [], []
            if len(met) > MET:
                met.clear()
            raws = [enc.ids(t.as_py().decode()) + end for t in b.column(1)]
            whole = np.frombuffer(b"".join(raws), "<u4")
            narrow = whole.astype("<u2").tobytes() if int(whole.max()) < 1 << 16 else None
            asked, to = marks(whole), np.cumsum([len(r) // 4 for r in raws])
            upto, at, done = np.searchsorted(asked, to, "right").tolist(), 0, 0
            for k, raw in enumerate(raws):
                n, last, refs = len(raw) // 4, 0, []
                for c in ends_of((asked[done : upto[k]] - at).tolist(), n):
                    name = digest(raw[4 * last : 4 * c])
                    refs.append(name + (c - last).to_bytes(4, "little"))
                    if name not in met:
                        met.add(name)
                        keys.append(name)
                        ids_of.append(None)
                        data.append(NARROW + narrow[2 * (at + last) : 2 * (at + c)] if narrow else pack_ids(whole[at + last : at + c]))
                        kinds.append(CHUNK)
                        slots.append(int.from_bytes(name[:4], "little", signed=True))
                    last = c
                at, done = at + n, upto[k]
                recipe = b"".join(refs)
                keys.append(digest(recipe))
                ids_of.append(k)
                data.append(recipe)
                kinds.append(RECIPE)
                slots.append(spread)
                spread += 1
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), b.column(0).take(pa.array(ids_of, pa.int32())), pa.array(data, pa.binary()), pa.array(kinds, pa.int32()), pa.array(slots, pa.int64())], names=["key", "doc_id", "ids", "kind", "slot"])

    return docs.select("doc_id", utf8().alias("_t")).mapInArrow(work, STAGED.format(id=docs.schema["doc_id"].dataType.simpleString()) + ", slot long")


def _once(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Without chunks that a former row of this partition has; all rows of a key are in one partition, next to each other."""
    last = None
    for b in it:
        keep = []
        for key, kind in zip(b.column(0).to_pylist(), b.column(3).to_pylist()):
            keep.append(kind != CHUNK or key != last)
            if kind == CHUNK:
                last = key
        yield b.filter(pa.array(keep, pa.bool_()))


class Merkle:
    """Root of the binary hash tree over leaves that come one by one, in memory that grows with its height."""

    def __init__(self) -> None:
        self.stack: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        stack = self.stack
        stack.append((0, digest(b"\0" + leaf)))
        while len(stack) > 1 and stack[-1][0] == stack[-2][0]:
            (h, right), (_, left) = stack.pop(), stack.pop()
            stack.append((h + 1, digest(b"\1" + left + right)))

    def root(self) -> bytes:
        out = None
        for _, left in reversed(self.stack):
            out = left if out is None else digest(b"\1" + left + out)
        return digest(b"") if out is None else out


RECIPES = "doc_id {id}, part int, row long, start long, n_tokens long, refs binary, root binary, last_id {id}"


def _ordered(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A part in doc_id order: recipes with their row and start, then its manifest."""
    from pyspark import TaskContext

    part, row, start, first, last = TaskContext.get().partitionId(), 0, 0, None, None
    tree, kind_type = Merkle(), None
    names = [x.split()[0] for x in RECIPES.split(", ")] + ["kind"]
    for b in it:
        if not b.num_rows:
            continue
        kind_type = b.column(0).type
        lengths = [int(np.frombuffer(r, np.uint8).reshape(-1, DIGEST + 4)[:, DIGEST:].copy().view("<u4").sum()) for r in b.column(2).to_pylist()]
        for key in b.column(1).to_pylist():
            tree.add(key)
        ends = np.cumsum(lengths) + start
        n = b.num_rows
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([part] * n, pa.int32()), pa.array(range(row, row + n), pa.int64()), pa.array(ends - lengths), pa.array(lengths, pa.int64()), b.column(2), pa.nulls(n, pa.binary()), pa.nulls(n, kind_type), pa.array([RECIPE] * n, pa.int32())],
            names=names,
        )
        if row == 0:
            first = b.column(0)[0]
        last, row, start = b.column(0)[n - 1], row + n, int(ends[-1])
    if row:
        one = [pa.array([first.as_py()], kind_type), pa.array([part], pa.int32()), pa.array([row], pa.int64()), pa.array([0], pa.int64()), pa.array([start], pa.int64()), pa.nulls(1, pa.binary()), pa.array([tree.root()], pa.binary()), pa.array([last.as_py()], kind_type), pa.array([MANIFEST], pa.int32())]
        yield pa.RecordBatch.from_arrays(one, names=names)


def write(docs: DataFrame, path: str, file: str = WORD_BPE) -> None:
    """Writes documents (doc_id, text) as a store under path."""
    spark, n = docs.sparkSession, parts(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    staged = STAGED.format(id=kind)
    rows = _staged(docs, file).repartition(n, "slot").select("key", "doc_id", "ids", "kind").sortWithinPartitions("kind", "key").mapInArrow(_once, staged)
    with shuffles_removed(spark):
        rows.write.partitionBy("kind").parquet(f"{path}/content")
    recipes = spark.read.schema(staged).parquet(f"{path}/content").filter(F.col("kind") == RECIPE).select("doc_id", "key", "ids")
    ordered = recipes.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "key").mapInArrow(_ordered, RECIPES.format(id=kind) + ", kind int")
    with shuffles_removed(spark):
        ordered.write.partitionBy("kind").parquet(f"{path}/recipes")


@cache
def _zeros(k: int) -> np.ndarray:
    """What 2**k zero bytes do to a crc32, as tables for its four bytes."""
    if k == 0:
        poly = np.uint32(0xEDB88320)
        bits = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            bits = np.where(bits & 1, (bits >> np.uint32(1)) ^ poly, bits >> np.uint32(1))
        at = np.arange(256, dtype=np.uint32)
        return np.stack([bits, at, at << np.uint32(8), at << np.uint32(16)])
    half = _zeros(k - 1)
    at = np.arange(256, dtype=np.uint32)
    return np.stack([_apply(half, _apply(half, at << np.uint32(8 * j))) for j in range(4)])


def _apply(t: np.ndarray, x: np.ndarray) -> np.ndarray:
    return t[0][x & 255] ^ t[1][x >> np.uint32(8) & 255] ^ t[2][x >> np.uint32(16) & 255] ^ t[3][x >> np.uint32(24)]


def shifted_crc(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """crc32 values as they count before n_bytes further bytes: crc32(a + b) = shifted(crc32(a), len(b)) ^ crc32(b)."""
    crc, n_bytes = crc.astype(np.uint32), n_bytes.astype(np.int64)
    for k in range(int(n_bytes.max(initial=0)).bit_length()):
        on = (n_bytes >> k & 1).astype(bool)
        if on.any():
            crc[on] = _apply(_zeros(k), crc[on])
    return crc


def _chunk_facts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        names, sizes, crcs = b.column(0).to_pylist(), [], []
        for name, data in zip(names, b.column(1).to_pylist()):
            raw = unpack_ids(data).tobytes()
            if digest(raw) != name:
                raise ValueError(f"chunk {name.hex()} is damaged")
            sizes.append(len(raw) // 4)
            crcs.append(zlib.crc32(raw))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], names=["chunk", "size", "crc"])


def _tables(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    chunks = spark.read.schema(STAGED.format(id=kind)).parquet(f"{path}/content").filter(F.col("kind") == CHUNK).select(F.col("key").alias("chunk"), "ids")
    recipes = spark.read.schema(RECIPES.format(id=kind) + ", kind int").parquet(f"{path}/recipes")
    return chunks, recipes.filter(F.col("kind") == RECIPE).drop("kind"), recipes.filter(F.col("kind") == MANIFEST).drop("kind")


def _refs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each reference: the ids of its document that come after it."""
    for b in it:
        part, row, chunk, size, after = [], [], [], [], []
        for p, r, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            rec = np.frombuffer(data, np.uint8).reshape(-1, DIGEST + 4)
            n = rec[:, DIGEST:].copy().view("<u4").ravel().astype(np.int64)
            part += [p] * len(n)
            row += [r] * len(n)
            chunk += [data[k : k + DIGEST] for k in range(0, len(data), DIGEST + 4)]
            size.append(n)
            after.append(n.sum() - np.cumsum(n))
        if part:
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(row, pa.int64()), pa.array(chunk, pa.binary()), pa.array(np.concatenate(size)), pa.array(np.concatenate(after))], names=["part", "row", "chunk", "want", "after"])


def _crc_parts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        if b.num_rows:
            crc = shifted_crc(b.column(2).to_numpy(), 4 * b.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(crc.astype(np.int64)), b.column(4)], names=["part", "row", "crc", "size"])


def read(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the stored documents; damaged chunks, parts and lengths raise."""
    chunks, recipes, manifests = _tables(spark, path, id_type)
    top = sorted(manifests.select("part", "row", "n_tokens").collect())  # a row a part
    starts, at = [], 0
    for p, _, n in top:
        starts.append((p, at))
        at += n
    offsets = spark.createDataFrame(starts, "part int, before long")
    facts = chunks.mapInArrow(_chunk_facts, "chunk binary, size long, crc long")
    refs = saved(recipes.select("part", "row", "refs").mapInArrow(_refs, "part int, row long, chunk binary, want long, after long"), "references")
    total = refs.count()
    often = F.broadcast(saved(refs.groupBy("chunk").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= max(64, -(-total // FREQUENT))).select("chunk"), "frequent"))  # FREQUENT rows at most
    told = "chunk binary, size long, crc long"
    hot = F.broadcast(saved(chunks.join(often.withColumnRenamed("chunk", "name"), F.col("chunk") == F.col("name"), "left_semi").mapInArrow(_chunk_facts, told), "frequent"))
    columns = ["part", "row", "want", "after", "size", "crc"]
    joined = refs.join(hot, "chunk").select(*columns).unionByName(refs.join(often, "chunk", "left_anti").join(facts, "chunk", "left").select(*columns))
    sound = F.when(F.col("size") == F.col("want"), F.col("crc")).otherwise(F.raise_error(F.lit("a chunk is missing or has another length")).cast("long"))
    crcs = joined.select("part", "row", sound.alias("crc"), "after", "want").mapInArrow(_crc_parts, "part int, row long, crc long, size long")
    whole = crcs.groupBy("part", "row").agg(F.bit_xor("crc").alias("ids_crc32"), F.sum("size").alias("_n"))
    out = recipes.select("doc_id", "part", "row", "start", "n_tokens").join(whole, ["part", "row"]).join(F.broadcast(offsets), "part")
    n = F.when(F.col("_n") == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a recipe has another length")).cast("long"))
    return out.select("doc_id", (F.col("before") + F.col("start")).alias("start"), n.alias("n_tokens"), "ids_crc32")


def verified(spark: SparkSession, path: str, id_type: str = "bigint") -> bool:
    """Each part's Merkle root over its recipes against the manifest; raises where they differ."""
    _, recipes, manifests = _tables(spark, path, id_type)

    def roots(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree = None, Merkle()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([tree.root()], pa.binary())], names=["part", "got"])

        for b in batches(it):
            for p, refs in zip(b.column(0).to_pylist(), b.column(1)):
                if at is not None and p != at:
                    yield out()
                    tree = Merkle()
                at = p
                tree.add(digest(refs.as_py()))
        if at is not None:
            yield out()

    got = recipes.select("part", "row", "refs").repartition(parts(spark), "part").sortWithinPartitions("part", "row").select("part", "refs").mapInArrow(roots, "part int, got binary")
    bad = manifests.join(got, "part", "full_outer").filter(~F.col("got").eqNullSafe(F.col("root"))).limit(1).collect()
    if bad:
        raise ValueError(f"part {bad[0]['part']} differs from its manifest")
    return True


def texts_of(spark: SparkSession, path: str, doc_ids: list[int], id_type: str = "bigint") -> DataFrame:
    """doc_id, ids: whole id streams of a few documents."""
    chunks, recipes, _ = _tables(spark, path, id_type)
    some = recipes.filter(F.col("doc_id").isin(doc_ids))
    refs = some.select("part", "row", "refs").mapInArrow(_refs, "part int, row long, chunk binary, want long, after long")
    streams = refs.join(chunks, "chunk").groupBy("part", "row").agg(F.sort_array(F.collect_list(F.struct((-F.col("after")).alias("k"), "ids"))).alias("all"))

    def joined(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids = [np.concatenate([unpack_ids(x["ids"]) for x in row]).astype(np.int64) for row in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    rows = some.join(streams, ["part", "row"]).select("doc_id", "all")
    return rows.mapInArrow(joined, f"doc_id {id_type}, ids array<bigint>")


def stored(docs: DataFrame, path: str | None = None, file: str = WORD_BPE) -> DataFrame:
    """Writes the store, by default into the shared folder, and reads it back."""
    spark = docs.sparkSession
    path = path or scratch(spark, "tokens")
    kind = docs.schema["doc_id"].dataType.simpleString()
    write(docs, path, file)
    verified(spark, path, kind)
    return read(spark, path, kind)
