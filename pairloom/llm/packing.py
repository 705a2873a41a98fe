"""Best-fit packing by a linear grouping scheme.

Method. Pieces are counted by length, LIMIT numbers at most, and the plan is made from those counts alone on the driver,
whatever the corpus' size. Large lengths (over a share of LIMIT, see SCHEMES) are cut, in descending order, into groups of equal
cardinality and rounded up to their group's largest. The few-size problem is solved by column generation: a fractional
optimum over configurations whose pricing step is a knapsack, rounded down. Actual documents take the configurations'
places, longest first, so real room is left over; what has no place yet, and all small pieces, goes best-fit into the
fullest sequences that still hold it, longest first, then into new ones. All sequences alike are handled as one run.

Places are dealt out by rank: pieces of a length are numbered within cells of hashed row numbers, cell sizes are added up, and
each (length, rank) falls into one run of the plan. A length has as many cells as its pieces need, CELLS and one a length in
all at most, so no task holds all pieces of a frequent length and what is broadcast is bounded.

Defined cases: a null text is an empty document, which is its end id alone; a document longer than LIMIT is cut so that all
pieces but the first are full; repeated rows and ids are packed each; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import batches, saved, utf8
from pairloom.llm.encoding import BYTE_BPE, encoder

LIMIT = 2048
END_ID = 0
#: (large, groups): lengths over LIMIT / large are cut into so many groups. The plan with the fewest sequences holds.
SCHEMES = ((2, 12), (3, 24), (4, 24))
CELLS = 1 << 16
#: Pieces of a cell, or more where there are more than CELLS such cells.
CELL = 256


def pieces(docs: DataFrame, limit: int = LIMIT, file: str = BYTE_BPE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, row: whole documents, and cut longer ones; row is the piece's own number."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end, row = encoder(file), np.array([END_ID], "<u4").tobytes(), TaskContext.get().partitionId() << 40
        for b in batches(it, 4 << 20):
            take, rows = [], []
            for k, t in enumerate(b.column(1)):
                ids = enc.ids(t.as_py().decode()) + end
                n = len(ids) // 4
                first = n % limit or limit
                for p, at in enumerate([0, *range(first, n, limit)]):
                    size = first if p == 0 else limit
                    take.append(k)
                    rows.append((p, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), row))
                    row += 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int32())), *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())))], names=["doc_id", "piece", "start", "length", "ids_crc32", "row"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", utf8().alias("_t")).mapInArrow(work, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, row long")


def _knapsack(sizes: np.ndarray, worth: np.ndarray, limit: int) -> np.ndarray:
    """How often to take each size (any number of times) for the largest worth within limit."""
    best, last = np.zeros(limit + 1), np.full(limit + 1, -1)
    for c in range(1, limit + 1):
        best[c], last[c] = best[c - 1], -1
        fit = np.flatnonzero(sizes <= c)
        if len(fit):
            v = best[c - sizes[fit]] + worth[fit]
            k = int(v.argmax())
            if v[k] > best[c] + 1e-12:
                best[c], last[c] = v[k], fit[k]
    out, c = np.zeros(len(sizes), np.int64), limit
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            out[last[c]] += 1
            c -= sizes[last[c]]
    return out


def configurations(sizes: np.ndarray, need: np.ndarray, limit: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """(how often each size, how many sequences): the fractional optimum by column generation, rounded down."""
    k = len(sizes)
    basis = np.diag(limit // sizes).astype(float)
    inverse, x = np.linalg.inv(basis), None
    for _ in range(rounds):
        x = inverse @ need
        dual = inverse.sum(axis=0)
        new = _knapsack(sizes, dual, limit).astype(float)
        if new @ dual <= 1 + 1e-7:
            break
        d = inverse @ new
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = new
        inverse = np.linalg.inv(basis)
    x = np.maximum(inverse @ need, 0)
    return [(np.rint(basis[:, j]).astype(np.int64), int(x[j] + 1e-9)) for j in range(k) if int(x[j] + 1e-9)]


class _Plan:
    """Runs of sequences alike, and the places of ranked pieces in them."""

    def __init__(self, counts: np.ndarray, limit: int) -> None:
        self.left, self.limit, self.used = counts.astype(np.int64).copy(), limit, 0
        self.rank = np.zeros(limit + 1, np.int64)
        self.places: list[tuple[int, int, int, int, int, int]] = []  # length, first rank, how many, first sequence, of each sequence, offset
        self.open: dict[int, list[tuple[int, int]]] = {}  # room to runs (first sequence, how many)
        self.rooms: list[int] = []

    def free(self, room: int, first: int, many: int) -> None:
        if many and room:
            if room not in self.open:
                self.open[room] = []
                insort(self.rooms, room)
            self.open[room].append((first, many))

    def put(self, length: int, first: int, many: int, each: int, room: int) -> None:
        """each pieces of length into each of many sequences that have room."""
        self.places.append((length, int(self.rank[length]), many * each, first, each, self.limit - room))
        self.rank[length] += many * each
        self.left[length] -= many * each

    def fill(self, length: int, first: int, many: int, room: int) -> None:
        """As many pieces of length as are left, sequence by sequence to its brim; the rest of the run stays open."""
        each, n = room // length, int(self.left[length])
        whole = min(many, n // each)
        if whole:
            self.put(length, first, whole, each, room)
            self.free(room - each * length, first, whole)
        rest = min(int(self.left[length]), each) if whole < many else 0
        if rest:
            self.put(length, first + whole, 1, rest, room)
            self.free(room - rest * length, first + whole, 1)
        self.free(room, first + whole + (rest > 0), many - whole - (rest > 0))

    def grouped(self, share: int, groups: int) -> None:
        """The large lengths' configurations, with actual lengths in their places."""
        large = np.arange(self.limit, self.limit // share, -1)
        n = self.left[large]
        total = int(n.sum())
        if not total:
            return
        ends = np.cumsum(n)
        owner = np.minimum((ends - n) * groups // total, groups - 1)  # by the rank of a length's first piece
        owner = owner[n > 0]
        lengths, n = large[n > 0], n[n > 0]
        ids, start = np.unique(owner, return_index=True)
        sizes, need = lengths[start], np.add.reduceat(n, start)
        stop = [*start[1:], len(lengths)]
        at = [(int(s), 0) for s in start]  # of each group: the length that is next, and how many of it are gone
        for config, many in sorted(configurations(sizes, need.astype(float), self.limit), key=lambda c: -c[1]):
            runs = [(self.used, many, self.limit)]
            self.used += many
            for g in np.flatnonzero(config):
                for _ in range(int(config[g])):
                    new = []
                    for first, m, room in runs:
                        while m:
                            k, gone = at[g]
                            if k == stop[g]:
                                new.append((first, m, room))
                                break
                            t = min(m, int(n[k]) - gone)
                            if t == 0:
                                at[g] = (k + 1, 0)
                                continue
                            self.put(int(lengths[k]), first, t, 1, room)
                            new.append((first, t, room - int(lengths[k])))
                            at[g] = (k, gone + t)
                            first, m = first + t, m - t
                    runs = new
            for first, m, room in runs:
                self.free(room, first, m)

    def best_fit(self) -> None:
        """Everything that is left, longest first, into the least room that holds it."""
        for length in range(self.limit, 0, -1):
            while self.left[length]:
                k = bisect_left(self.rooms, length)
                if k == len(self.rooms):
                    many = -(-int(self.left[length]) // (self.limit // length))
                    first, self.used = self.used, self.used + many
                    self.fill(length, first, many, self.limit)
                    continue
                room = self.rooms[k]
                first, many = self.open[room].pop()
                if not self.open[room]:
                    del self.open[room], self.rooms[k]
                self.fill(length, first, many, room)


def plan(counts: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, int]:
    """(places sorted by length and rank, number of sequences) for counts[length] pieces of each length."""
    best = None
    for share, groups in SCHEMES:
        p = _Plan(counts, limit)
        p.grouped(share, groups)
        p.best_fit()
        if best is None or p.used < best.used:
            best = p
    places = np.array(sorted(best.places), np.int64).reshape(-1, 6)
    return places, best.used


def packed(docs: DataFrame, limit: int = LIMIT, file: str = BYTE_BPE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    rows = saved(pieces(docs, limit, file), "pieces")
    got = rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).toPandas()  # limit rows at most
    counts = np.zeros(limit + 1, np.int64)
    counts[got["length"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    places, _ = plan(counts, limit)
    shared = spark.sparkContext.broadcast(places)
    size = max(CELL, -(-int(counts.sum()) // CELLS))
    cells = spark.createDataFrame([(k, -(-int(n) // size)) for k, n in enumerate(counts) if n], "length long, cells long")  # limit rows at most
    rows = rows.join(F.broadcast(cells), "length").withColumn("cell", F.pmod(F.xxhash64("row"), F.col("cells")))
    sizes = rows.groupBy("length", "cell").agg(F.count(F.lit(1)).alias("n"))  # CELLS + limit rows at most
    before = sizes.select("length", "cell", (F.sum("n").over(Window.partitionBy("length").orderBy("cell")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "cell").orderBy("row"))
    ranked = rows.withColumn("n", within).join(F.broadcast(before), ["length", "cell"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = ranked.select(*names, (F.col("before") + F.col("n") - 1).cast("long").alias("rank"))

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        key = table[:, 0] << 44 | table[:, 1]
        for b in it:
            if not b.num_rows:
                continue
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            run = table[np.searchsorted(key, length << 44 | rank, "right") - 1]
            k = rank - run[:, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(run[:, 3] + k // run[:, 4]), pa.array(run[:, 5] + k % run[:, 4] * length)], names=[*names, "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(work, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
