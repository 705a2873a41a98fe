"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked by a binary trie self-join.

Method. Each document gets a fingerprint (majority bits of the XXH64 of its 3-word shingles, repeats included).
Equal fingerprints become one class. A binary trie over the classes is joined with itself: node pairs are
traversed together, differing bits are added up, and a pair is pruned once it exceeds the Hamming budget.

Distribution. For a budget of e bits the 64 positions fall into e+1 blocks; two fingerprints within the budget agree
on one block at least. So there are e+1 tries, each with another block as its first levels, and only subtrees
under *equal* first levels can hold a link: such a subtree is a task's unit. A subtree with more than LEAF_ROWS
classes is cut again the same way over its remaining bits (their e+1 blocks), until it is small or its bits are
used up. The self-join emits a spanning set of links, at most one per class and unit, never all pairs: node pairs
whose leaves are connected already are skipped. Components are found by star contraction over tables in the shared folder.

Defined cases: null or empty text has fingerprint 0 and is linked like any other; fewer than 3 words: the whole
sequence is the one shingle; repeated rows and equal ids are kept as rows; a null id is kept, never a component's
name unless the component has none but null ids; empty tables give empty results; other columns of the input are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import batches, discard, fresh, parts, saved, trimmed, utf8

BITS = 64
BUDGET = 2
SHINGLE = 3
#: Edges whose components one task finds.
TOGETHER = 1 << 20
#: Classes that one traversal takes; larger subtrees are cut again.
LEAF_ROWS = 2000
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes, width: int = SHINGLE, seed: int = 42) -> int:
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    shingles = [b" ".join(words)] if len(words) <= width else map(b" ".join, zip(*(words[i:] for i in range(width))))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, seed) for s in shingles), np.uint64, n)
    octets = h.astype("<u8").view(np.uint8).reshape(n, 8)
    ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *cols: str, text_col: str = "text") -> DataFrame:
    """cols, fp (the 64 bits as a signed long)."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, col=0):
            fps = np.array([fingerprint(t) for t in b.column(0).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(fps)], names=[*cols, "fp"])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in cols)
    return docs.select(utf8(text_col).alias("_t"), *cols).mapInArrow(work, f"{kinds}fp long")


class _Forest:
    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def trie_links(fps: np.ndarray, budget: int = BUDGET, leaf: int = 32) -> list[tuple[int, int]]:
    """A spanning set of the links among distinct sorted unsigned fps (indices), by joining their binary trie with itself.

    A node is a range of the sorted array plus the bit that splits it. A pair of nodes carries the bits at which their
    paths differ; it is pruned beyond the budget, and skipped once all its leaves are in one component.
    """
    n, forest, links = len(fps), _Forest(len(fps)), []

    def compare(a: int, b: int, c: int, d: int) -> None:
        near = np.argwhere(np.bitwise_count(fps[a:b, None] ^ fps[None, c:d]) <= budget)
        for i, j in near:
            if a + i < c + j and forest.join(a + i, c + j):
                links.append((a + int(i), c + int(j)))

    def split(lo: int, hi: int, bit: int) -> int:
        return lo + int(np.searchsorted(fps[lo:hi] >> np.uint64(bit) & np.uint64(1), 1))

    def one(lo: int, hi: int) -> bool:
        r = forest.root(lo)
        return all(forest.root(i) == r for i in range(lo + 1, hi))

    # Entries: (a, b, c, d, bit, differing bits above bit). a == c: a node with itself.
    stack = [(0, n, 0, n, BITS - 1, 0)]
    while stack:
        a, b, c, d, bit, off = stack.pop()
        if a >= b or c >= d or off > budget:
            continue
        if a == c:
            if b - a < 2:
                continue
            # go to the bit at which this node branches
            bit = int(fps[a] ^ fps[b - 1]).bit_length() - 1
            if b - a <= leaf:
                compare(a, b, c, d)
                continue
            m = split(a, b, bit)
            stack += [(a, m, m, b, bit - 1, 1), (m, b, m, b, bit - 1, 0), (a, m, a, m, bit - 1, 0)]
            continue
        if (b - a) * (d - c) <= leaf * leaf:
            compare(a, b, c, d)
            continue
        if b - a + d - c > 4 * leaf and one(a, b) and one(c, d) and forest.root(a) == forest.root(c):
            continue
        m, k = split(a, b, bit), split(c, d, bit)
        stack += [(a, m, k, d, bit - 1, off + 1), (m, b, c, k, bit - 1, off + 1), (m, b, k, d, bit - 1, off), (a, m, c, k, bit - 1, off)]
    return links


def _blocks(free: list[int], budget: int) -> list[list[int]]:
    return [list(x) for x in np.array_split(np.array(free), budget + 1)]


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << BITS) if m >= 1 << (BITS - 1) else m


def links(classes: DataFrame, budget: int = BUDGET, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """a, b (a < b): links that connect all classes (node, fp) within the budget; fp is distinct, node its name."""
    spark, found = classes.sparkSession, []
    # A path is the mask of the bits fixed so far; a unit is a path and the bits' values.
    todo = [([], list(range(BITS)), classes.select("node", "fp"))]
    while todo:
        unit, level, todo = None, todo, []
        for fixed, free, rows in level:
            for block in _blocks(free, budget):
                path = fixed + block
                new = rows.select("node", "fp", F.lit(_mask(path)).cast("long").alias("mask"), F.col("fp").bitwiseAND(F.lit(_mask(path))).alias("path"))
                unit = new if unit is None else unit.unionAll(new)
        sizes = unit.groupBy("mask", "path").agg(F.count(F.lit(1)).alias("_n"))
        # a subtree with no more free bits than the budget is all links, and small
        cut = [(path, rest, rows) for fixed, free, rows in level for block in _blocks(free, budget) for path, rest in [(fixed + block, [b for b in free if b not in block])] if len(rest) > budget]
        can = F.col("mask").isin([_mask(path) for path, _, _ in cut]) if cut else F.lit(False)
        big = saved(sizes.filter((F.col("_n") > leaf_rows) & can), "subtrees")
        heavy = {r["mask"] for r in big.select("mask").distinct().collect()}  # one a block at most
        small = unit
        if heavy:
            small = unit.join(big.select("mask", "path"), ["mask", "path"], "left_anti")
            for path, rest, rows in cut:
                if _mask(path) in heavy:
                    sub = big.filter(F.col("mask") == F.lit(_mask(path))).select("path")
                    keep = rows.withColumn("path", F.col("fp").bitwiseAND(F.lit(_mask(path)))).join(sub, "path", "left_semi").select("node", "fp")
                    todo.append((path, rest, keep))
        found.append(_joined(small, budget))
    out = found[0]
    for x in found[1:]:
        out = out.unionAll(x)
    return out


def _joined(units: DataFrame, budget: int) -> DataFrame:
    """Each unit's trie joined with itself; units are read one after another from rows sorted by unit."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out(rows: np.ndarray) -> pa.RecordBatch | None:
            if len(rows) < 2:
                return None
            order = np.argsort(rows[:, 1].view(np.uint64), kind="stable")
            node, fps = rows[order, 0], rows[order, 1].copy().view(np.uint64)
            got = np.array(trie_links(fps, budget), np.int64).reshape(-1, 2)
            x, y = node[got[:, 0]], node[got[:, 1]]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"]) if len(got) else None

        last = None
        for b in it:
            rows = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(4)], axis=1)  # node, fp, mask, path
            cuts = [0, *np.flatnonzero((rows[1:, 2:] != rows[:-1, 2:]).any(axis=1)) + 1, len(rows)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo or hi == lo + 1 and 0 < lo and hi < len(rows):
                    continue  # nothing, or a unit of one
                piece = rows[lo:hi]
                if last is not None and last != (piece[0, 2], piece[0, 3]):
                    if (x := out(np.concatenate(held))) is not None:
                        yield x
                    held = []
                held.append(piece)
                last = (piece[0, 2], piece[0, 3])
        if held and (x := out(np.concatenate(held))) is not None:
            yield x

    n = parts(units.sparkSession)
    return units.repartition(n, "mask", "path").sortWithinPartitions("mask", "path").select("node", "fp", "mask", "path").mapInArrow(work, "a long, b long")


def _told(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first())


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted nodes of some edges, and the smallest node of each one's component: roots are hooked to smaller ones until no edge has two."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, up = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(x):
        x, y = up[x], up[y]
        on = x != y
        x, y = np.minimum(x[on], y[on]), np.maximum(x[on], y[on])
        np.minimum.at(up, y, x)
        while not np.array_equal(further := up[up], up):
            up = further
    return nodes, nodes[up]


def _forest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a (the smallest), b: a star for each component of a task's edges, of so many at a time; each star's centre stands with itself as well."""
    held, size = [], 0

    def out() -> pa.RecordBatch:
        b, a = contracted(*(np.concatenate(x) for x in zip(*held)))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for b in it:
        held.append([b.column(0).to_numpy(), b.column(1).to_numpy()])
        size += b.num_rows
        if size >= TOGETHER:
            yield out()
            held, size = [], 0
    if size:
        yield out()
    trimmed()


def components(edges: DataFrame) -> DataFrame:
    """node, root: for each node of edges (a, b) but the smallest of a component, that smallest one.

    Each task makes its own edges stars. Up to TOGETHER of those meet in one task. More take star contraction: large-star and
    small-star steps in turn, each a shuffle of the edges, until nothing changes; a plan a step is what the driver holds, so few edges don't take it.
    """
    edges = saved(edges.select("a", "b").mapInArrow(_forest, "a long, b long"), "forests")
    if edges.count() <= TOGETHER:
        one = saved(edges.coalesce(1).mapInArrow(_forest, "a long, b long"), "roots")
        discard(edges)
        return one.filter("a < b").select(F.col("b").alias("node"), F.col("a").alias("root"))
    before, edges = edges, saved(edges.filter("a < b").distinct(), "edges")
    discard(before)
    now = _told(edges)
    while True:
        # large star: each node sends its larger neighbours to its smallest one
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        # small star: each node sends its smaller neighbours, and itself, to the smallest of them
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a < b").unionAll(low.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()
        before, edges = edges, saved(small, "edges")
        discard(before)
        was, now = now, _told(edges)
        if now == was:
            break
    return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))


def fingerprint_roots(fps: DataFrame, budget: int = BUDGET) -> DataFrame:
    """fp, root: each distinct fingerprint of fps (fp, ...) and the name of its component, a fingerprint too."""
    classes = saved(fps.select("fp").distinct(), "classes")
    roots = components(links(classes.select(F.col("fp").alias("node"), "fp"), budget))
    return classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """id_col, fingerprint (hex), component_id: smallest id reachable over links of at most budget differing bits."""
    fps = saved(fingerprints(docs, id_col, text_col=text_col), "fingerprints")
    # ids may repeat over fingerprints, so links run between fingerprints; their names are found afterwards
    named = fingerprint_roots(fps, budget).join(fps.groupBy("fp").agg(F.min(id_col).cast("long").alias("node")), "fp")
    name = named.groupBy("root").agg(F.min("node").alias("component_id"))
    # ids that repeat tie their fingerprints' components together only by the smallest id, as a result is by row
    label = named.join(name, "root").select("fp", "component_id")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return fps.join(label, "fp").select(id_col, hexed, "component_id")


def later_rows(fps: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """key: the rows of fps (key, doc_id, fp) but the first of each component of roots (fp, root): that of its smallest doc_id, then key."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", key)).alias("first")
    # by fingerprint first, so that the copies of a text meet as one row a task
    firsts = fps.groupBy("fp").agg(first).join(roots, "fp").groupBy("root").agg(F.min("first").alias("first")).select(F.col(f"first.{key}").alias(key))
    return fps.select(key).join(firsts.hint("shuffle_hash"), key, "left_anti")


def numbered(docs: DataFrame, key: str) -> DataFrame:
    """docs as a saved table, so that the rows' numbers in column key stay."""
    return saved(docs.withColumn(key, F.monotonically_increasing_id()), "rows")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each component, that of its smallest doc_id; decided row by row, so rows with equal ids or none are documents of their own."""
    key = fresh("row", docs)
    rows = numbered(docs, key)
    fps = saved(fingerprints(rows, key, "doc_id"), "fingerprints")
    return rows.join(later_rows(fps, fingerprint_roots(fps), key).hint("shuffle_hash"), key, "left_anti").select(docs.columns)
