"""Quality classifier: Naive Bayes support vectors.

Method. A document is the set of its byte n-grams (1 to 4 bytes, hashed into FEATURES). Over all training documents
the log-count ratio of each feature between the two classes is counted; indicators are scaled by it and normalised
to length one. A linear model under hinge loss is fitted to them by dual coordinate descent on a bounded sample, and its
margins are turned into probabilities by a logistic curve fitted on a second one.

Bounds: the fit takes the FIT_ROWS training documents of each class with the smallest id hash, the curve the CURVE_ROWS
next ones of either class as they come, one text of each id; class counts and ratios cover every training document.

Defined cases: null text is an empty one, has no feature and scores by the bias alone; very long texts are read whole;
repeated rows are scored each; labels with a null id or class are left out, of labels that disagree for an id the larger
holds; a single class, or none, gives its share of the training labels (0.5 if there are none) to every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import batches, crc_of, utf8, with_ids_of

FEATURES = 1 << 16
FIT_ROWS = 2500
CURVE_ROWS = 2500
PRIOR = 1.0
COST = 1.0
EPOCHS = 12
THRESHOLD = 0.3
FOLDS, HELD = 5, 0


def features(text: bytes) -> np.ndarray:
    """Sorted ids of the n-grams that occur."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    flag = np.zeros(FEATURES, bool)
    code = np.zeros(len(b), np.uint32)
    for n in range(1, 5):
        if len(b) < n:
            break
        code = code[: len(b) - n + 1] * np.uint32(257) + b[n - 1 :] + np.uint32(1)
        flag[(code * np.uint32(2654435769)) >> np.uint32(16)] = True
    return np.flatnonzero(flag)


def hinge_fit(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> np.ndarray:
    """Weights, the last one for the bias, of min |w|^2/2 + sum cost*hinge, by coordinate descent in the dual."""
    rng, w = np.random.default_rng(seed), np.zeros(len(scale) + 1)
    x = []
    for r in rows:
        v = scale[r]
        x.append(np.append(v / (np.linalg.norm(v) or 1.0), 1.0))
    ids = [np.append(r, len(scale)) for r in rows]
    square = np.array([v @ v for v in x])
    alpha = np.zeros(len(rows))
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            grad = y[i] * (w[ids[i]] @ x[i]) - 1
            new = min(max(alpha[i] - grad / square[i], 0.0), cost[i])
            if new != alpha[i]:
                w[ids[i]] += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def margin(ids: np.ndarray, scale: np.ndarray, w: np.ndarray) -> float:
    v = scale[ids]
    return float(w[ids] @ v / (np.linalg.norm(v) or 1.0) + w[-1])


def logistic_fit(m: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """a, b of P(y=1) = 1/(1+exp(-(a*m+b))), with smoothed targets, by damped Newton steps."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([((p - t) * m).sum() + 1e-3 * (a - 1), (p - t).sum()])
        q = p * (1 - p)
        h = np.array([[(q * m * m).sum() + 1e-3, (q * m).sum()], [(q * m).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-7:
            break
    return float(a), float(b)


def training_labels(labels: DataFrame) -> DataFrame:
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("y"))
    return known.filter(crc_of("doc_id") % FOLDS != HELD)


def class_counts(docs: DataFrame, known: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """([2, FEATURES] document counts of the features by class, [2] documents). Only texts that may be labelled are shuffled."""
    rows = with_ids_of(docs, known).select("y", "_t")

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, FEATURES + 1), np.int64)  # the last one counts documents
        for b in batches(it):
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                k = int(y > 0)
                sums[k, features(t)] += 1
                sums[k, -1] += 1
        at = np.flatnonzero(sums.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0][at]), pa.array(sums[1][at])], names=["f", "n0", "n1"])

    got = rows.mapInArrow(work, "f long, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()  # FEATURES + 1 rows at most
    sums = np.zeros((2, FEATURES + 1), np.int64)
    sums[0][got["f"]], sums[1][got["f"]] = got["n0"], got["n1"]
    return sums[:, :-1], sums[:, -1]


def log_count_ratio(counts: np.ndarray) -> np.ndarray:
    p = counts + PRIOR
    p = p / p.sum(axis=1, keepdims=True)
    return np.log(p[1] / p[0])


def _sample(docs: DataFrame, known: DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Features of the rows for the fit and for the curve: bounded numbers, chosen by the hash of the id."""
    h = F.xxhash64(F.col("doc_id"), F.lit(11))
    parts = [known.filter(c).orderBy(h, "doc_id").limit(FIT_ROWS).select("doc_id", "y", F.lit(0).alias("use")) for c in ("y > 0", "y <= 0")]
    other = known.orderBy(F.xxhash64(F.col("doc_id"), F.lit(12)), "doc_id").limit(CURVE_ROWS).select("doc_id", "y", F.lit(1).alias("use"))
    chosen = parts[0].unionAll(parts[1]).unionAll(other)  # 2*FIT_ROWS + CURVE_ROWS rows at most

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, col=2):
            f = [features(t).astype(np.uint16).tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(f, pa.binary())], names=["y", "use", "doc_id", "f"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = docs.select("doc_id", utf8().alias("_t")).join(F.broadcast(chosen), "doc_id").select("y", "use", "_t", "doc_id")
    # ids may repeat; one text of each is taken, the one whose features come first
    got = got.mapInArrow(work, f"y int, use int, doc_id {kind}, f binary").groupBy("use", "doc_id", "y").agg(F.min("f").alias("f")).toPandas().sort_values(["use", "doc_id", "f"])
    return got[got.use == 0], got[got.use == 1]


def _ids(column: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16).astype(np.int64) for x in column]


def fitted(docs: DataFrame, labels: DataFrame) -> dict:
    known = training_labels(labels).select("doc_id", F.col("y").cast("int").alias("y"))
    counts, n = class_counts(docs, known)
    if not n.all():
        share = 0.5 if not n.any() else float(n[1] > 0)
        return {"share": share}
    scale = log_count_ratio(counts)
    fit, curve = _sample(docs, known)
    y = np.where(fit.y > 0, 1.0, -1.0)
    # classes weigh alike in the fit; the curve brings their true shares back
    cost = COST * np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    w = hinge_fit(_ids(fit.f), y, scale, cost)
    seen = set(fit.doc_id)
    own = curve[~curve.doc_id.isin(seen)]
    if own.y.nunique() < 2:
        own = curve
    a, b = logistic_fit(np.array([margin(r, scale, w) for r in _ids(own.f)]), own.y.to_numpy())
    return {"scale": scale, "w": w, "a": a, "b": b}


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches(it, col=2):
            if "share" in m:
                s = np.full(b.num_rows, m["share"])
            else:
                s = np.array([m["a"] * margin(features(t), m["scale"], m["w"]) + m["b"] for t in b.column(2).to_pylist()])
                s = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (crc_of("doc_id") % FOLDS == HELD).alias("held_out"), utf8().alias("_t"))
    return rows.mapInArrow(work, f"doc_id {kind}, held_out boolean, score double, predicted int")
