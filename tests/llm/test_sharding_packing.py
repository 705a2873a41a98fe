import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pairloom.llm import encoding, packing, sharding, token_store


def best_capacity(sizes, shards):
    """By dynamic programming over all cuts."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    cost = ends[1:].astype(float)
    for _ in range(shards - 1):
        cost = np.array([min(max(cost[j - 1] if j else 0, ends[i + 1] - ends[j]) for j in range(i + 1)) for i in range(len(sizes))])
    return cost[-1]


@given(st.lists(st.integers(1, 50), min_size=1, max_size=25), st.integers(1, 6))
@settings(max_examples=60, deadline=None)
def test_minimax(sizes, shards):
    cuts, capacity = sharding.minimax_cuts(sizes, shards)
    assert capacity == best_capacity(sizes, shards) and len(cuts) <= shards and cuts[0] == 0
    assert max(sum(sizes[a:b]) for a, b in zip(cuts, [*cuts[1:], len(sizes)])) <= capacity


def check_shards(rows, n):
    groups = {}
    for r in rows:
        groups.setdefault((r.size, r.text_crc32), set()).add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < n
    assert all(len(g) == 1 for g in groups.values())
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_shards(docs, hard, nothing):
    rows = sharding.sharded(docs).collect()
    want = sorted((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    check_shards(rows, 40)
    rows = sharding.sharded(hard).collect()
    assert len(rows) == hard.count()
    check_shards(rows, 40)
    assert sharding.sharded(nothing).count() == 0


def test_a_heavy_group_stands_alone(spark):
    df = spark.createDataFrame([(k, "same text " * 9) for k in range(300)] + [(1000 + k, f"other {k} " * 9) for k in range(600)], "doc_id long, text string")
    rows = sharding.sharded(df, 10).collect()
    check_shards(rows, 10)
    by = {}
    for r in rows:
        by[r.shard] = by.get(r.shard, 0) + r.size
    rest = sorted(by.values())[:-1]
    assert len(by) == 10 and max(rest) <= 1.1 * sum(rest) / 9


def check_plan(lengths, limit):
    counts = np.bincount(lengths, minlength=limit + 1)
    places, used = packing.plan(counts, limit)
    seen, fill = np.zeros(limit + 1, int), {}
    for length, rank, n, first, each, at in places.tolist():
        assert rank == seen[length]
        seen[length] += n
        for k in range(n):
            fill.setdefault(first + k // each, []).append((at + k % each * length, length))
    assert (seen == counts).all() and len(fill) == used
    for v in fill.values():
        end = 0
        for at, length in sorted(v):
            assert at == end
            end += length
        assert end <= limit
    return used


@given(st.lists(st.integers(1, 64), max_size=120))
@settings(max_examples=40, deadline=None)
def test_plan(lengths):
    used = check_plan(np.array(lengths, int), 64)
    assert used >= -(-sum(lengths) // 64)


def test_plan_is_tight():
    rng = np.random.default_rng(0)
    lengths = np.clip(rng.lognormal(6, 1, 4000).astype(int), 1, 2048)
    assert check_plan(lengths, 2048) <= 1.01 * -(-lengths.sum() // 2048) + 1


def test_configurations_serve_the_need():
    sizes, need = np.array([700, 500, 300]), np.array([60.0, 90.0, 120.0])
    got = packing.configurations(sizes, need, 2048)
    assert all((c * sizes).sum() <= 2048 for c, _ in got)
    assert (sum(c * n for c, n in got) <= need + sizes.size * 6).all()


def expected_pieces(rows, limit=2048):
    t, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []
    for r in rows:
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % limit or limit
        for p, a in enumerate([0, *range(first, len(ids), limit)]):
            part = ids[a : first if p == 0 else a + limit]
            out.append((str(r.doc_id), p, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out)


def test_packed(docs, hard, nothing):
    for df in (docs, hard):
        rows = packing.packed(df).collect()
        assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected_pieces(df.collect())
        by = {}
        for r in rows:
            by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for v in by.values():
            end = 0
            for at, n in sorted(v):
                assert at == end
                end += n
            assert end <= 2048
    assert packing.packed(nothing).count() == 0


@given(st.text(alphabet="ab C'sdlm\n\t1²éÉ<|>endoftx!?.  İſ中́", max_size=40))
@settings(max_examples=150, deadline=None)
def test_cached_ids_are_the_librarys(text):
    for file in (encoding.BYTE_BPE, encoding.WORD_BPE):
        e = encoding.encoder(file)
        assert np.frombuffer(e.ids(text), "<u4").tolist() == e.library.encode(text, add_special_tokens=False).ids


def test_bounded_caches(monkeypatch):
    for k, v in (("CACHE", 3), ("YOUNGER", 2), ("TURNS", 2), ("LONGEST", 9)):
        monkeypatch.setattr(encoding, k, v)
    for file in (encoding.BYTE_BPE, encoding.WORD_BPE):
        e = encoding.Encoder(file)
        text = "one two, three four. one five six seven! one two a-very-long-word-that-is-not-kept eight nine ten, one"
        for _ in range(3):
            assert np.frombuffer(e.ids(text), "<u4").tolist() == e.library.encode(text, add_special_tokens=False).ids
            for c in (e.first, e.spaced, e.pieces):
                assert len(c) <= 3 and len(c.younger) <= 2 and all(len(k) <= 9 for k in c)


def expected_store(rows):
    t, at, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    ids = [(r.doc_id, np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")) for r in rows]
    for k, v in sorted(ids, key=lambda x: (x[0] is not None, x[0] or 0)):
        out.append((k, at, len(v), zlib.crc32(v.tobytes())))
        at += len(v)
    return out, dict(ids)


def test_store(spark, docs, nothing, tmp_path):
    path = str(tmp_path / "store")
    rows = token_store.stored(docs, path).collect()
    want, ids = expected_store(docs.collect())
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows) == want
    some = sorted(ids)[:5]
    got = {r.doc_id: r.ids for r in token_store.texts_of(spark, path, some).collect()}
    assert all(got[k] == ids[k].tolist() for k in some)
    assert token_store.stored(nothing).count() == 0


def test_store_of_hard_rows(hard):
    rows = sorted(token_store.stored(hard).collect(), key=lambda r: r.start)
    want, _ = expected_store(hard.collect())
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in rows) == sorted((str(a), n, c) for a, _, n, c in want)
    assert [r.start for r in rows] == np.concatenate([[0], np.cumsum([r.n_tokens for r in rows])[:-1]]).tolist()
    ids = [r.doc_id for r in rows if r.doc_id is not None]
    assert ids == sorted(ids) and rows[0].doc_id is None


def test_store_finds_damage(spark, docs, tmp_path):
    import pytest
    from pyspark.sql import functions as F

    path = str(tmp_path / "store")
    token_store.write(docs.limit(20), path)
    chunks = [[bytes(r.key), None, bytes(r.ids)] for r in spark.read.parquet(f"{path}/content").filter("kind = 0").collect()]
    chunks[0][2] = bytes([2]) + b"\x07\x00" * ((len(chunks[0][2]) - 1) // 2)
    import shutil

    shutil.rmtree(f"{path}/content/kind=0")
    spark.createDataFrame(chunks, "key binary, doc_id long, ids binary").write.parquet(f"{path}/content/kind=0")
    with pytest.raises(Exception, match="damaged"):
        token_store.read(spark, path).agg(F.sum("ids_crc32")).collect()


@given(st.binary(max_size=60), st.binary(max_size=60))
@settings(max_examples=60, deadline=None)
def test_crc_of_joined_bytes(a, b):
    got = token_store.shifted_crc(np.array([zlib.crc32(a)]), np.array([len(b)]))[0] ^ zlib.crc32(b)
    assert got == zlib.crc32(a + b)


def test_chunks_follow_content():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 49000, 5000), rng.integers(0, 49000, 700)
    whole, moved = token_store.cuts(a), token_store.cuts(np.concatenate([b, a]))
    assert whole[-1] == 5000 and max(np.diff([0, *whole])) <= token_store.MOST
    assert len({c for c in whole} & {c - 700 for c in moved}) > 0.8 * len(whole)
