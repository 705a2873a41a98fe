from itertools import combinations

import corpus_pipeline
from pyspark.sql import functions as F
from test_decontam import is_found
from test_near_copies import components_of, sets_by_hand, similar_pairs
from test_sharding_packing import expected_pieces
from test_texts import fingerprint_by_hand, spans_by_hand

from pairloom.llm import quality_rules, registry, secrets


def distinct_by_hand(texts):
    """ids of texts that stay: the smallest of each component over fingerprints and similar sets."""
    fps, sets = {k: fingerprint_by_hand(t) for k, t in texts.items()}, {k: s for k, t in texts.items() if (s := sets_by_hand(t))}
    links = [(a, b) for a, b in combinations(sorted(texts), 2) if (fps[a] ^ fps[b]).bit_count() <= 2]
    return set(components_of(texts, links + similar_pairs(sets)).values())


def redacted_by_hand(text, spans):
    out, at = [], 0
    islands = []
    for a, b in sorted((int(x.split(":")[1]), int(x.split(":")[2])) for x in spans.split(",") if x):
        if islands and a < islands[-1][1]:
            islands[-1][1] = max(islands[-1][1], b)
        else:
            islands.append([a, b])
    for a, b in islands:
        out.append(text[at:a])
        at = b
    return "[SECRET]".join([*out, text[at:]])


def test_stages(spark, sf):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dedup", "decontamination", "secret_scan", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, bench = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    kept = {r.doc_id for r in quality_rules.scored(docs, labels).filter("kept").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in kept}
    texts = {k: texts[k] for k in distinct_by_hand(texts)}
    texts = {k: t for k, t in texts.items() if not any(is_found(t, r.text) for r in bench)}
    spans = {r.doc_id: r.spans for r in secrets.report(docs)[0].collect()}
    texts = {k: redacted_by_hand(t, spans[k]) for k, t in texts.items()}
    out = docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, out, sf)
        assert out.columns == docs.columns
    rows = out.collect()
    assert {r.doc_id: r.text for r in rows} == texts and all(spans_by_hand(t) == "" for t in texts.values())
    packed = corpus_pipeline.run(spark, sf).collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in packed) == expected_pieces(rows)


def test_stages_of_hard_tables(spark, sf, hard, nothing, tmp_path):
    """Every stage on hard and empty tables and clashing columns; rows that no rule rejects stay as they are."""
    clash = hard.withColumns({c: F.lit(f"own {c}") for c in ("row", "fp", "id", "th", "blob", "gaps", "spans", "label", "h", "kept", "item_id", "set")})
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, clash, sf)
        rows = out.collect()
        assert out.columns == clash.columns and out.schema["text"].dataType == clash.schema["text"].dataType, name
        assert all(r[c] == f"own {c}" for r in rows for c in ("row", "fp", "id", "th", "blob", "gaps", "spans", "label", "h", "kept", "item_id", "set")), name
        assert f(spark, nothing, sf).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, clash, sf).count() == len(expected_pieces(hard.collect()))
    for table, name in ((hard, "hard"), (nothing, "nothing")):
        path = str(tmp_path / name)
        table.write.parquet(f"{path}/documents.parquet")
        for other in ("labels", "benchmark"):
            spark.read.parquet(f"{sf}/{other}.parquet").limit(0 if name == "nothing" else 50).write.parquet(f"{path}/{other}.parquet")
        got = corpus_pipeline.run(spark, path)
        assert got.count() >= 0 and "sequence_id" in got.columns


def test_registered(spark):
    import __spark_entry__ as e

    q = e.queries()
    assert [n.split("_")[0] for n in registry.queries()] == [f"op{k}" for k in range(1, 11)]
    assert set(registry.queries()) | {"pipeline"} <= set(q)
