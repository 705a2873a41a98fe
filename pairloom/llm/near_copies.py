"""Near copies by the similarity of their shingle sets, as a stage after SimHash: Jaccard similarity of SIMILAR over 5-word shingles.

Every pair of that similarity links, and no other; nothing is capped or estimated. The steps:

1. A text's name is a hash of its words, so copies are one node. Of every set the hashes below SAMPLED (of small sets all) are
   counted over the corpus. A set in which more than a fifth is nobody else's has no similar one and is done with; that takes
   most documents out by one shuffle of hashes. A task sends a hash that two of its own nodes have as one row, so a passage
   that a third of all documents share is a row a task.
2. Of what is left, two similar sets share one of their first n - ceil(SIMILAR*n) + 1 hashes in any one order of all hashes
   (prefix filter). The order is rare before frequent, so shared passages stand last. Nodes meet under these hashes. Sizes, and
   the places of the hash they meet at, rule pairs out.
3. Under a hash with up to POSTING nodes all pairs are compared by their whole sets; with more, each with the NEXT ones in one
   order of all nodes, so that a group of near copies costs a few comparisons a node. Hashes whose nodes are still in several
   components are dealt in another order each round, and neighbours of different components compared, and others with some of
   the largest one, as long as that adds one link in MORE. Then what is left is gone through in blocks: every pair of different components that nothing rules out is compared.
   Here sketches rule pairs out too: a sketch's bit is the parity of the set's hashes that fall on it, so two sets differ in at
   least as many hashes as their sketches in bits, and a set is fetched only for a pair that can still be similar.
4. Whole sets are shuffled in slices of pairs, each of a bounded share of the texts' bytes, however many pairs there are.

Defined cases: ASCII lower case and white space; fewer than 5 words: the whole sequence is the one shingle; texts without words
are left to the fingerprints, which are equal; ids may repeat or be null, as rows are told apart by their own numbers; an empty table stays
empty; other columns of the input, whatever their names, come back as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial, reduce
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import batches, bits_of, bytes_of, discard, fresh, hash_of_long, may_hold, parts, saved, utf8
from pairloom.llm.simhash import components, fingerprint_roots, fingerprints, later_rows, numbered

SHINGLE = 5
#: Similarity 4 / 5: two sets of x and y hashes share 4 / 9 of x + y at least.
OVER, UNDER = 4, 5
#: Share of all hashes that are counted, of 2**64; sets of up to SMALL hashes are counted whole.
SAMPLED = np.uint64(int(0.35 * (1 << 64)))
SMALL = 128
POSTING, NEXT = 8, 2
MORE, TRIES = 200, 4
#: Hashes with this share of the sets' hashes or more stand last in the order; so many at most.
FREQUENT = 1 << 16
_WORDS = 100_000
_ROWS = 300_000
_BLOCK = 512
#: log2 of the bits of a sketch.
SKETCH = 9
#: Sets that one slice of pairs sends, as a share of the texts' bytes; and bytes below which there are no slices.
SLICE, WHOLE = 0.4, 64 << 20


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, 42)
        if len(self) < _WORDS and len(word) < 64:
            self[word] = h
        return h


def shingles(words: list[bytes], known: Words) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    h = np.array([known[w] for w in words], np.uint64)
    n = max(len(h) - SHINGLE + 1, min(len(h), 1))
    out = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(h))):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B185EBCA87)
        out ^= out >> np.uint64(32)
    return np.unique(out * np.uint64(0xC2B2AE3D27D4EB4F))


def spare(n: int) -> int:
    """How many of n hashes a similar set may lack."""
    return n - -(-OVER * n // UNDER)


def named(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words), 42) - (1 << 63)


def shared_counts(rows: DataFrame, key: str) -> DataFrame:
    """node, c (how many of its counted hashes other nodes have too, or more), need (how many a node with a similar one has at least), row (its first)."""
    names = ["h", "node", "c", "need", "row"]

    def batch(h: np.ndarray, node: np.ndarray, c: np.ndarray, need: np.ndarray | None = None, row: np.ndarray | None = None) -> pa.RecordBatch:
        none = pa.nulls(len(h), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(node), pa.array(c), none if need is None else pa.array(need), none if row is None else pa.array(row)], names=names)

    def told(h: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        """c 0: a hash and its node; -1: a hash that is known to be shared; more: a node's shared hashes."""
        order = np.lexsort((node, h))
        h, node = h[order], node[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (node[1:] != node[:-1])])
        h, node = h[new], node[new]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        n = np.diff([*first, len(h)])
        alone = np.repeat(n, n) == 1
        yield batch(h[alone], node[alone], np.zeros(alone.sum(), np.int64))
        if not alone.all():
            yield batch(h[first[n > 1]], np.zeros((n > 1).sum(), np.int64), np.full((n > 1).sum(), -1))
            own, c = np.unique(node[~alone], return_counts=True)
            yield batch(own.view(np.uint64), own, c)

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = Words(), [], 0
        for b in batches(it, 2 << 20):
            need, nodes, numbers = [], [], []
            for row, t in zip(b.column(0).to_pylist(), b.column(1)):
                words = t.as_py().lower().split()
                if not words:
                    continue
                s, node = shingles(words, known), named(words)
                del words
                some = s[: np.searchsorted(s, SAMPLED)]
                told_all = len(s) <= SMALL and UNDER * len(s) <= OVER * SMALL  # then similar sets are counted whole too
                need.append((len(s) if told_all else len(some)) - spare(len(s)))
                nodes.append(node)
                numbers.append(row)
                out = s if len(s) <= SMALL else some
                held.append((out, np.full(len(out), node)))
                size += len(out)
                if size > _ROWS:
                    yield from told(*(np.concatenate(x) for x in zip(*held)))
                    held, size = [], 0
            if nodes:
                own = np.array(nodes)
                yield batch(own.view(np.uint64), own, np.full(len(own), -2), np.array(need), np.array(numbers))
        if size:
            yield from told(*(np.concatenate(x) for x in zip(*held)))

    def met(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """node, c of the rows of each hash, which stand together; the others pass."""
        last, held = None, []

        def out(x: np.ndarray) -> pa.RecordBatch:
            h, node, c = x.T
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            n = np.diff([*first, len(h)])
            low = np.minimum.reduceat(c, first)
            one = c == 0
            lone = np.minimum.reduceat(np.where(one, node, np.iinfo(np.int64).max), first) == np.maximum.reduceat(np.where(one, node, np.iinfo(np.int64).min), first)
            on = np.repeat((low < 0) | ~lone, n) & one
            pairs = np.unique(np.stack([h[on], node[on]], axis=1), axis=0) if on.any() else np.zeros((0, 2), np.int64)
            own, times = np.unique(pairs[:, 1], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(own), pa.array(times), pa.nulls(len(own), pa.int64()), pa.nulls(len(own), pa.int64())], names=names[1:])

        for b in it:
            x = np.stack([b.column(i).to_numpy() for i in range(3)], axis=1)
            plain = (x[:, 2] == 0) | (x[:, 2] == -1)
            if not plain.all():
                own = b.filter(pa.array(~plain))
                yield pa.RecordBatch.from_arrays([own.column(1), pa.array(np.maximum(own.column(2).to_numpy(), 0)), own.column(3), own.column(4)], names=names[1:])
            x = x[plain]
            if len(x):
                held.append(x)
                if sum(map(len, held)) > _ROWS:
                    x = np.concatenate(held)
                    whole = int(np.searchsorted(x[:, 0], x[-1, 0]))  # the last hash may go on
                    if whole:
                        yield out(x[:whole])
                    held = [x[whole:]]
        if held and len(x := np.concatenate(held)):
            yield out(x)

    kinds = "node long, c long, need long, row long"
    sent = rows.select(key, utf8().alias("_t")).mapInArrow(work, f"h long, {kinds}")
    got = sent.repartition(parts(rows.sparkSession), "h").sortWithinPartitions("h").mapInArrow(met, kinds)
    return got.groupBy("node").agg(F.sum("c").alias("c"), F.max("need").alias("need"), F.min("row").alias("row"))


def _sets(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """node, set: whole sets of the wanted rows (row)."""
    spark = rows.sparkSession
    bits = spark.sparkContext.broadcast(bits_of(wanted.select(F.xxhash64("row").alias("h"))))

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for b in batches(it, 2 << 20):
            on = np.flatnonzero(may_hold(bits.value, hash_of_long(b.column(0).to_numpy().view(np.uint64))))
            words = [b.column(1)[k].as_py().lower().split() for k in on.tolist()]
            kept = [k for k, w in zip(on.tolist(), words) if w]
            words = [w for w in words if w]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(kept, pa.int64())), pa.array([named(w) for w in words], pa.int64()), pa.array([shingles(w, known).view(np.int64) for w in words], pa.list_(pa.int64()))], names=["row", "node", "set"])

    got = rows.select(key, utf8().alias("_t")).mapInArrow(work, "row long, node long, set array<long>")
    return got.join(wanted.select("row").hint("shuffle_hash"), "row", "left_semi").select("node", "set")


def frequent(sets: DataFrame) -> np.ndarray:
    """Sorted hashes that many sets hold, FREQUENT at most. They only order the hashes, so a count by task that misses rare ones will do."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[n > 1]), pa.array(n[n > 1].astype(np.int64))], names=["h", "n"])

        for b in it:
            held.append(b.column(0).flatten().to_numpy())
            size += len(held[-1])
            if size > _ROWS:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    total = sets.agg(F.coalesce(F.sum(F.size("set").cast("long")), F.lit(0))).first()[0]
    often = sets.select("set").mapInArrow(work, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(POSTING, -(-total // FREQUENT)))
    return np.sort(often.select("h").toArrow()["h"].to_numpy().view(np.uint64))


def prefixes(sets: DataFrame) -> DataFrame:
    """g, node, n, at: the hashes that a similar set shares one of, the set's size, the hash's place in the order."""
    shared = sets.sparkSession.sparkContext.broadcast(frequent(sets))

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for b in batches_of_lists(it):
            out = []
            for node, s in zip(b.column(0).to_pylist(), b.column(1)):
                s = np.sort(s.values.to_numpy().view(np.uint64))
                if len(often):
                    last = often[np.minimum(np.searchsorted(often, s), len(often) - 1)] == s
                    s = np.concatenate([s[~last], s[last]])
                k = spare(len(s)) + 1
                out.append(np.stack([s[:k].view(np.int64), np.full(k, node), np.full(k, len(s)), np.arange(k)], axis=1))
            if out:
                x = np.concatenate(out)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, i]) for i in range(4)], names=["g", "node", "n", "at"])

    return sets.select("node", "set").mapInArrow(work, "g long, node long, n long, at long")


def batches_of_lists(it: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for b in it:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def sketch(s: np.ndarray) -> np.ndarray:
    """The parity, as bits of 64-bit numbers, of how many of the hashes fall on each of 2**SKETCH places."""
    odd = np.bincount((s >> np.uint64(64 - SKETCH)).astype(np.int64), minlength=1 << SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def sketches(sets: DataFrame) -> DataFrame:
    """node, s0, s1 and so on."""
    names = [f"s{k}" for k in range((1 << SKETCH) // 64)]

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of_lists(it):
            x = np.stack([sketch(s.values.to_numpy().view(np.uint64)) for s in b.column(1)])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x[:, k]) for k in range(len(names)))], names=["node", *names])

    return sets.select("node", "set").mapInArrow(work, ", ".join(f"{c} long" for c in ["node", *names]))


def may_be_similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of rows g, node, n, at, root and the sketch can be similar: they differ in no fewer hashes than their sketches in bits."""
    n = a[:, 2] + b[:, 2]
    apart = np.bitwise_count((a[:, 5:] ^ b[:, 5:]).view(np.uint64)).sum(axis=1, dtype=np.int64)
    return (OVER + UNDER) * (n - apart) >= 2 * OVER * n


def open_pairs(n: np.ndarray, at: np.ndarray, m: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Whether sets of n and m hashes that first meet at these places of their orders can be similar."""
    return (OVER + UNDER) * np.minimum(n - at, m - to) >= OVER * (n + m)


def pairs_within(rows: np.ndarray) -> np.ndarray:
    """Distinct pairs (a < b) to be compared first, of rows g, node, n, at sorted by g and node."""
    g, node, n, at = rows[:, :4].T
    cut = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    size = np.repeat(np.diff([*cut, len(g)]), np.diff([*cut, len(g)]))
    out = []
    for d in range(1, POSTING):
        on = (g[d:] == g[:-d]) & ((size[d:] <= POSTING) | (d <= NEXT)) & open_pairs(n[:-d], at[:-d], n[d:], at[d:]) & (node[d:] != node[:-d])
        out.append(np.stack([node[:-d][on], node[d:][on]], axis=1))
    return np.unique(np.concatenate(out), axis=0)


def _mixed(rows: np.ndarray) -> Iterator[np.ndarray]:
    """Of rows g, node, n, at, root and the sketch, sorted by g: the groups with more than POSTING nodes in more than one component."""
    cut = [*np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]])), len(rows)]
    for lo, hi in zip(cut, cut[1:]):
        x = rows[lo:hi]
        if hi - lo > POSTING and (x[:, 4] != x[0, 4]).any():
            yield x


def _between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The pairs of two equally long runs of rows that can be similar and are in different components."""
    on = open_pairs(a[:, 2], a[:, 3], b[:, 2], b[:, 3]) & (a[:, 4] != b[:, 4])
    a, b = a[on], b[on]
    on = may_be_similar(a, b)
    return np.stack([np.minimum(a[on, 1], b[on, 1]), np.maximum(a[on, 1], b[on, 1])], axis=1)


def pairs_dealt(rows: np.ndarray, turn: int) -> Iterator[np.ndarray]:
    """In an order of this turn's own: neighbours of different components, and each row outside the largest one with TRIES rows of that."""
    for x in _mixed(rows):
        x = x[np.argsort(hash_of_long(x[:, 1].view(np.uint64), turn), kind="stable")]
        yield from (_between(x[:-d], x[d:]) for d in range(1, NEXT + 1))
        _, of, n = np.unique(x[:, 4], return_inverse=True, return_counts=True)
        top, rest = x[of == n.argmax()], x[of != n.argmax()]
        yield from (_between(rest, top[(np.arange(len(rest)) * TRIES + k) % len(top)]) for k in range(min(TRIES, len(top))))


def pairs_across(rows: np.ndarray) -> Iterator[np.ndarray]:
    """All pairs (a < b) of different components, block by block."""
    for x in _mixed(rows):
        x = x[np.argsort(x[:, 2], kind="stable")]  # by size: a block meets only those that aren't too large
        for i in range(0, len(x), _BLOCK):
            a = x[i : i + _BLOCK]
            top = int(np.searchsorted(x[:, 2], UNDER * a[-1, 2] // OVER, "right"))
            for j in range(i, top, _BLOCK):
                b = x[j : min(j + _BLOCK, top)]
                p, q = np.nonzero(open_pairs(a[:, None, 2], a[:, None, 3], b[None, :, 2], b[None, :, 3]) & (a[:, None, 4] != b[None, :, 4]))
                yield _between(a[p], b[q])


def _candidates(rows: DataFrame, pairs) -> DataFrame:
    """a, b: distinct pairs of the groups of rows by g. pairs: rows of whole groups to arrays of pairs."""
    n_cols = len(rows.columns)

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, found, size = np.zeros((0, n_cols), np.int64), [], 0

        def out() -> pa.RecordBatch:
            p = np.unique(np.concatenate(found), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])

        def groups() -> Iterator[np.ndarray]:
            nonlocal held
            for b in it:
                held = np.concatenate([held, np.stack([b.column(i).to_numpy() for i in range(n_cols)], axis=1)])
                if not len(held):
                    continue
                whole = int(np.searchsorted(held[:, 0], held[-1, 0]))  # the last group may go on
                if whole:
                    yield held[:whole]
                    held = held[whole:]
            if len(held):
                yield held

        for x in groups():
            for p in pairs(x):
                found.append(p)
                size += len(p)
                if size > _ROWS:
                    yield out()
                    found, size = [], 0
        if found:
            yield out()

    return rows.repartition(parts(rows.sparkSession), "g").sortWithinPartitions("g", "node").mapInArrow(work, "a long, b long").distinct()


def _similar(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar, as a table. Slices of pairs send sets of about share bytes each: both sides by the node, and one again with each pair."""
    pairs = saved(pairs, "pairs")
    n, (nodes, hashes) = pairs.count(), sets.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("set").cast("long")), F.lit(0))).first()
    size = 8 * hashes * (2 + n / max(nodes, 1))
    turns = 1 if size <= share else 1 + math.isqrt(int(size / share))
    found = []
    for i in range(turns):
        for j in range(turns):
            part = [F.pmod(F.col(c), F.lit(turns)) == k for c, k in (("a", i), ("b", j))] if turns > 1 else [F.lit(True)] * 2
            x, y = sets.select(F.col("node").alias("a"), F.col("set").alias("x")).filter(part[0]), sets.select(F.col("node").alias("b"), F.col("set").alias("y")).filter(part[1])
            both = pairs.filter(part[0] & part[1]).join(x, "a").join(y, "b")
            found.append(saved(both.filter((OVER + UNDER) * F.size(F.array_intersect("x", "y")) >= OVER * (F.size("x") + F.size("y"))).select("a", "b"), "similar"))
    discard(pairs)
    return reduce(DataFrame.unionByName, found)


def _labelled(met: DataFrame, links: DataFrame, drawn: DataFrame) -> DataFrame:
    """g, node, n, at, root and the sketch of the nodes under hashes with several components."""
    rows = met.join(components(links).hint("shuffle_hash"), "node", "left").select("g", "node", "n", "at", F.coalesce("root", "node").alias("root"))
    mixed = rows.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("g")
    return rows.join(mixed.hint("shuffle_hash"), "g", "left_semi").join(drawn.hint("shuffle_hash"), "node").select("g", "node", "n", "at", "root", *drawn.columns[1:])


def similar(rows: DataFrame, key: str) -> DataFrame:
    """a, b (a < b): names of texts that are similar, with a link between any two that such pairs connect; key numbers the rows."""
    counts = shared_counts(rows, key)
    wanted = saved(counts.filter(F.col("c") >= F.col("need")).select("row"), "shared")
    sets = saved(_sets(rows, key, wanted), "sets", compression="uncompressed")
    discard(wanted)
    share = max(WHOLE, int(SLICE * bytes_of(rows)))
    met = saved(prefixes(sets), "prefixes")
    found = _similar(_candidates(met, lambda x: [pairs_within(x)]), sets, share)
    many = met.join(met.groupBy("g").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > POSTING).select("g").hint("shuffle_hash"), "g", "left_semi")
    many = saved(many, "frequent-prefixes")
    discard(met)
    drawn = saved(sketches(sets.join(many.select("node").distinct().hint("shuffle_hash"), "node", "left_semi")), "sketches")
    for turn in count(1):
        new = _similar(_candidates(_labelled(many, found, drawn), partial(pairs_dealt, turn=turn)), sets, share)
        known, found = found.count(), found.unionByName(new)
        if MORE * new.count() <= known:
            break
    found = found.unionByName(_similar(_candidates(_labelled(many, found, drawn), pairs_across), sets, share))
    discard(sets, many, drawn)
    return found


def names(rows: DataFrame, key: str) -> DataFrame:
    """key, node: the names of texts with words."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            words = [t.lower().split() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([named(w) if w else None for w in words], pa.int64())], names=[key, "node"])

    return rows.select(key, utf8().alias("_t")).mapInArrow(work, f"`{key}` long, node long").filter("node is not null")


def distinct(docs: DataFrame) -> DataFrame:
    """One row of each component that SimHash links and links of similar texts make together: that of its smallest doc_id."""
    key = fresh("row", docs)
    rows = numbered(docs, key)
    fps = saved(fingerprints(rows, key, "doc_id"), "fingerprints")
    pairs = saved(similar(rows, key), "near-copies")
    roots = saved(fingerprint_roots(fps), "roots")
    # links between texts, told by their fingerprints' components
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    of = saved(names(rows, key).join(nodes.hint("shuffle_hash"), "node", "left_semi").join(fps.select(key, "fp"), key).groupBy("node").agg(F.min("fp").alias("fp")).join(roots, "fp").select("node", "root"), "names")
    edges = pairs.join(of.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").join(of.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
    wider = components(edges.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("top"))
    roots = roots.join(wider.hint("shuffle_hash"), "root", "left").select("fp", F.coalesce("top", "root").alias("root"))
    gone = later_rows(fps, roots, key)
    return rows.join(gone.hint("shuffle_hash"), key, "left_anti").select(docs.columns)
