"""Language identification: nearest of several clustered centroids per language, by cosine over TF-IDF byte n-grams.

Method. A text is the vector of its byte n-grams (1 to 3 bytes of its letters, hashed into DIMS): log counts times
inverse document frequency, length one. Document frequencies cover all training documents. On a bounded sample
(PER_LANG documents of each language, chosen by id hash) spherical k-means gives CENTROIDS centroids a language. A
text takes the language of the nearest centroid; the score is that language's share of a softmax over the languages' best
cosines. A text farther from its centroid than all but REJECT of that language's sample, with MARGIN, is marked rejected;
the nearest language is told all the same.

Defined cases: null text or one without a letter: ``und``, score 0; very long texts are read whole; repeated rows are
predicted each; null or missing languages are not learned from; no training document: every prediction is ``und``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import batches, crc_of

DIMS = 1 << 13
PER_LANG = 400
CENTROIDS = 4
ROUNDS = 12
REJECT = 0.002
MARGIN = 1.25
HEAT = 0.05
FOLDS, HELD = 4, 2
#: ASCII letters lowered, all other ASCII a space, so that marks and digits say nothing.
_LETTERS = bytes(c | 0x20 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace"))


def counts(text: bytes) -> np.ndarray:
    words = b" ".join(text.translate(_LETTERS).split())
    b = np.frombuffer(b" " + words + b" ", np.uint8).astype(np.uint32)
    out, code = np.zeros(DIMS, np.int64), np.zeros(len(b), np.uint32)
    for n in range(1, 4):
        if len(b) < n:
            break
        code = code[: len(b) - n + 1] * np.uint32(257) + b[n - 1 :] + np.uint32(1)
        out += np.bincount((code * np.uint32(2654435769)) >> np.uint32(19), minlength=DIMS)
    return out


def vector(text: bytes, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts(text)) * idf
    return v / (np.linalg.norm(v) or 1.0)


def clustered(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means from farthest-point seeds; rows of length one."""
    seeds = [0]
    best = x @ x[0]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin(best)))
        best = np.maximum(best, x @ x[seeds[-1]])
    c = x[seeds]
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        new = np.stack([x[near == j].sum(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, c):
            break
        c = new
    return c


def fitted(docs: DataFrame) -> dict | None:
    train = docs.filter("text is not null and lang is not null").filter(crc_of("doc_id") % FOLDS != HELD)
    train = train.select("doc_id", F.col("text").cast("binary").alias("_t"), "lang")

    def frequencies(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMS, np.int64), 0
        for b in batches(it, col=0):
            for t in b.column(0).to_pylist():
                df += counts(t) > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([*range(DIMS), -1]), pa.array([*df.tolist(), n])], names=["f", "n"])

    got = train.select("_t").mapInArrow(frequencies, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toPandas()  # DIMS + 1 rows
    df = np.zeros(DIMS + 1, np.int64)
    df[got["f"]] = got["n"]
    if not df[-1]:
        return None
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 0.05
    known = docs.filter("text is not null and lang is not null").filter(crc_of("doc_id") % FOLDS != HELD).select("doc_id", "lang").distinct()
    hashed = F.xxhash64(F.col("doc_id"), F.lit(5))
    # a bound of the hash leaves each language some times PER_LANG ids, however many it has; all of them where that is too few
    share = F.least(F.lit(1.0), F.lit(4.0 * PER_LANG) / F.col("n"))
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select("lang", ((share - 0.5) * 2.0**64).alias("bound"))  # a row a language
    some = known.join(F.broadcast(sizes), "lang").filter(hashed.cast("double") <= F.col("bound"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(hashed, "doc_id"))
    chosen = some.withColumn("_r", rank).filter(F.col("_r") <= PER_LANG)

    def sample(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, col=1):
            v = [vector(t, idf).astype(np.float32).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(v, pa.binary()), b.column(2)], names=["lang", "v", "doc_id"])

    # PER_LANG ids a language at most, and of texts that share one the one whose vector comes first
    rows = train.join(F.broadcast(chosen.select("doc_id", "lang")), ["doc_id", "lang"]).select("lang", "_t", "doc_id")
    rows = rows.mapInArrow(sample, f"lang string, v binary, doc_id {docs.schema['doc_id'].dataType.simpleString()}").groupBy("lang", "doc_id").agg(F.min("v").alias("v")).toPandas()
    langs, centroids, owner, far = sorted(rows.lang.unique()), [], [], []
    for k, lang in enumerate(langs):
        x = np.stack(sorted((np.frombuffer(v, np.float32) for v in rows.v[rows.lang == lang]), key=lambda v: v.tobytes())).astype(np.float64)
        c = clustered(x, CENTROIDS)
        centroids.append(c)
        owner += [k] * len(c)
        far.append(MARGIN * float(np.quantile(1 - (x @ c.T).max(axis=1), 1 - REJECT)))
    return {"idf": idf, "langs": langs, "centroids": np.concatenate(centroids).astype(np.float32), "owner": np.array(owner), "far": np.array(far)}


def nearest(texts: list[bytes], m: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language number, score, rejected) of each text."""
    x = np.stack([vector(t, m["idf"]).astype(np.float32) for t in texts])
    cos = x @ m["centroids"].T
    best = np.stack([cos[:, m["owner"] == k].max(axis=1) for k in range(len(m["langs"]))], axis=1).astype(np.float64)
    lang = best.argmax(axis=1)
    p = np.exp((best - best.max(axis=1, keepdims=True)) / HEAT)
    return lang, 1 / p.sum(axis=1), 1 - best.max(axis=1) > m["far"][lang]


def predicted(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs))

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches(it, 1 << 20, col=2):
            texts = b.column(2).to_pylist()
            for lo in range(0, len(texts), 256):
                part = texts[lo : lo + 256]
                told = [t is not None and m is not None and has_letter(t) for t in part]
                if m is None:
                    lang, score, out = [None] * len(part), np.zeros(len(part)), np.ones(len(part), bool)
                else:
                    at, score, out = nearest([t or b"" for t in part], m)
                    lang = [m["langs"][k] for k in at]
                rows = b.slice(lo, len(part))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array([x if y else "und" for x, y in zip(lang, told)]), pa.array(np.where(told, score, 0.0)), pa.array(np.where(told, out, True))],
                    names=["doc_id", "held_out", "lang_pred", "score", "rejected"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (crc_of("doc_id") % FOLDS == HELD).alias("held_out"), F.col("text").cast("binary").alias("_t"))
    return rows.mapInArrow(work, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")
