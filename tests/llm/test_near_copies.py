from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from pairloom.llm import near_copies, simhash


def sets_by_hand(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_stage_drops_near_copies(spark):
    """Copies beyond the two bits of op7 that share four fifths of their shingles."""
    words = [f"w{k * k % 7919}" for k in range(200)]
    near, far = list(words), list(words)
    for k in (20, 80, 140):
        near[k] = f"changed{k}"
    for k in range(10, 200, 20):
        far[k] = f"other{k}"
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (4, "one two"), (5, "one two three"), (None, " ".join(words)), (6, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fp = {r.doc_id: int(r.fingerprint, 16) for r in simhash.near_duplicates(df).collect()}
    assert (fp[1] ^ fp[2]).bit_count() > 2
    out = corpus_pipeline.near_dedup(spark, df, "")
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == {1, 3, 4, 5, 6}


def components_of(nodes, pairs):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        up[max(root(a), root(b))] = min(root(a), root(b))
    return {n: root(n) for n in nodes}


def similar_pairs(sets):
    return [(a, b) for a, b in combinations(sorted(sets), 2) if 5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b])) and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]


def check_similar(spark, rows):
    """Links and their components against all pairs."""
    df = spark.createDataFrame(rows, "row long, text string").repartition(3)
    name = {near_copies.named(t.encode().lower().split()): k for k, t in reversed(rows) if t and t.split()}
    sets = {k: sets_by_hand(dict(rows)[k]) for k in name.values()}
    got = {tuple(sorted((name[r.a], name[r.b]))) for r in near_copies.similar(df, "row").collect()}
    want = similar_pairs(sets)
    assert got <= set(want) and components_of(sets, got) == components_of(sets, want)
    return want


def test_similar_by_hand(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    assert check_similar(spark, [(r.doc_id, r.text) for r in docs])


def test_random_groups_by_hand(spark, monkeypatch):
    """Groups of all likenesses around one half with shared passages, small and large sets, so that pairs stand on both sides of the limit."""
    rng = np.random.default_rng(5)
    monkeypatch.setattr(near_copies, "_BLOCK", 7)
    vocabulary = [f"v{k}" for k in range(4000)]
    passage = " ".join(rng.choice(vocabulary, 60))
    rows = []
    for group in range(12):
        base = list(rng.choice(vocabulary, [6, 30, 110, 400][group % 4]))
        for _ in range(25):
            w = list(base)
            for at in rng.integers(0, len(w), rng.integers(0, max(2, len(w) // 20))):
                w[at] = rng.choice(vocabulary)
            rows.append(" ".join(w) if rng.random() < 0.6 else " ".join([*w, passage][:: rng.choice([1, -1])]))
    rows += [f"{passage} {' '.join(rng.choice(vocabulary, rng.integers(1, 16)))}" for _ in range(60)]
    assert len(check_similar(spark, list(enumerate(rows)))) > 100


def test_large_groups(spark):
    """Comparisons grow with the group; all of it is one component still."""
    base = [f"v{k * k % 7919}" for k in range(300)]
    df = spark.createDataFrame([(k, " ".join(base[: k % 290] + [f"x{k}"] + base[k % 290 :])) for k in range(400)], "doc_id long, text string")
    assert near_copies.similar(df, "doc_id").count() < 400 * 30 and [r.doc_id for r in near_copies.distinct(df).collect()] == [0]


def test_hard_rows(spark, hard, nothing):
    """Row by row: unlike texts of one id stay, copies without an id go; columns of any name come back."""
    out = near_copies.distinct(hard)
    want = sorted(str((r.doc_id, r.text)) for r in simhash.deduplicated(hard).collect())
    assert out.columns == hard.columns and sorted(str((r.doc_id, r.text)) for r in out.collect()) == want
    assert near_copies.distinct(nothing).count() == 0
    clash = hard.select("doc_id", "text", F.lit(1).alias("row"), F.lit("x").alias("fp"), F.lit("y").alias("node"), F.lit(2).alias("set"))
    got = near_copies.distinct(clash)
    assert got.columns == clash.columns and {(r.row, r.fp, r.node, r["set"]) for r in got.collect()} == {(1, "x", "y", 2)} and got.count() == len(want)


def test_unlike_texts_of_a_large_group(spark, monkeypatch):
    """Texts with four changes each of one base meet under its shingles and aren't similar: their sets are not fetched pair by pair."""
    rng = np.random.default_rng(3)
    base, compared, similar = [f"v{k}" for k in range(200)], [], near_copies._similar

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return similar(pairs, *rest)

    monkeypatch.setattr(near_copies, "_similar", counted)
    rows = []
    for k in range(120):
        w = list(base)
        for at in rng.choice(18, 4, replace=False) * 10 + 10:
            w[at] = f"x{k}-{at}"
        rows.append((k, " ".join(w)))
    check_similar(spark, rows)
    assert sum(compared[1:]) < 1000


def test_sketches_rule_out_no_similar_pair():
    rng = np.random.default_rng(4)
    for n in (5, 40, 300, 3000):
        s = rng.integers(0, 1 << 64, 2 * n, np.uint64, endpoint=False)
        for lost in range(0, n // 4 + 1, max(1, n // 40)):
            a, b = s[:n], s[lost : n + lost]
            x, y = (np.concatenate([[0, 0, n, 0, 0], near_copies.sketch(v)])[None] for v in (a, b))
            assert 9 * (n - lost) < 8 * n or near_copies.may_be_similar(x, y)[0]
    x, y = (np.concatenate([[0, 0, 300, 0, 0], near_copies.sketch(v)])[None] for v in (s[:300], s[150:450]))
    assert not near_copies.may_be_similar(x, y)[0]


def test_slices_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "SLICE", 0)
    monkeypatch.setattr(near_copies, "WHOLE", 60_000)
    base = [f"v{k * k % 7919}" for k in range(120)]
    check_similar(spark, [(k, " ".join(base[: k % 110] + [f"x{k}"] * (1 + k % 3) + base[k % 110 :])) for k in range(60)])
