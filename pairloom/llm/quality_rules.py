"""Quality rules: Gopher-like base counts, then a hashed n-gram log-likelihood ratio with a fixed threshold.

Method. Uni- and bigrams of words (ASCII lower case) are hashed into BUCKETS. Two multinomials are counted over whole
texts: the trusted target (documents that labels call quality 1) and the raw corpus (all documents). A document's
score is the sum over its n-grams of log(target/raw), divided by their number; it is kept if the score reaches
THRESHOLD, so equal texts always fare alike. Counts are dense vectors of fixed size, one per task, added up by bucket.

Composite words are rare, so n-grams are of word *shapes* as well: letters that repeat the corpus' long tail say
nothing, while marks, capitals, digits and separators around words do; both kinds share the buckets.

Defined cases: null text has no words and fails the base; very long texts are counted whole; repeated rows count and are
judged as often as they stand there; labels that repeat or disagree count once, quality 1 winning; no labels or no
trusted rows: every ratio is 0 and only the base decides; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import SPACE, batches, utf8, with_ids_of

BUCKETS = 1 << 16
#: Mean log ratio a document must reach.
THRESHOLD = -0.25
#: Pseudo-count of each bucket in either multinomial.
PRIOR = 1.0
MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
_NOT_IN_WORDS = SPACE + bytes(range(0x80, 0xC0))
_SHAPE = bytes(
    0x61 if 0x61 <= c <= 0x7A else 0x41 if 0x41 <= c <= 0x5A else 0x30 if 0x30 <= c <= 0x39 else 0x75 if c >= 0x80 else c for c in range(256)
)


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    n = len(words)
    chars = len(text.translate(None, _NOT_IN_WORDS))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    dup = len(lines) - len(set(lines))
    repeat = 0
    if n >= 3:
        first: dict[bytes, int] = {}
        ids = np.fromiter(map(first.setdefault, words, count()), np.int64, n)
        if n >= 1 << 21:  # three ids do not fit 63 bits: name pairs first
            pair = np.unique(ids[:-1] << 31 | ids[1:], return_inverse=True)[1]
            keys = pair[:-1] << 31 | ids[2:]
        else:
            keys = ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:]
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        if same.any():
            often = np.zeros(n - 2, bool)
            often[order[1:][same]] = True
            often[order[:-1][same]] = True
            cover = np.zeros(n, bool)
            for k in range(3):
                cover[k : n - 2 + k] |= often
            repeat = int(cover.sum())
    return n, chars, symbols, dup, repeat


def ngrams(text: bytes) -> np.ndarray:
    """Buckets of the words, the word pairs and the pairs of word shapes."""
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(crc32, text.lower().split()), np.uint64, n)
    shapes = text.translate(_SHAPE).split()
    s = np.fromiter(map(crc32, [x[:1] + x[-3:] for x in shapes]), np.uint64, n)
    mult = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        pairs = (h[:-1] * np.uint64(3) + h[1:] + np.uint64(1 << 40)) * mult
        shaped = (s[:-1] * np.uint64(5) + s[1:] + np.uint64(1 << 41)) * mult
        all_ = np.concatenate([h * mult, pairs, shaped, (s + np.uint64(1 << 42)) * mult])
    return (all_ >> np.uint64(48)).astype(np.int64)


def _counted(texts: DataFrame) -> np.ndarray:
    """n-gram counts by bucket over texts (_t)."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS, np.int64)
        for b in batches(it, col=0):
            for t in b.column(0).to_pylist():
                sums += np.bincount(ngrams(t), minlength=BUCKETS)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["bucket", "n"])

    rows = texts.select("_t").mapInArrow(work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS rows at most
    out = np.zeros(BUCKETS)
    out[rows["bucket"]] = rows["n"]
    return out


def bucket_counts(docs: DataFrame, trusted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(target, raw): n-gram counts over the trusted and over all documents. trusted: doc_id, once each. Only texts that may be trusted are shuffled."""
    return _counted(with_ids_of(docs, trusted)), _counted(docs.select(utf8().alias("_t")))


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    if not target.any():
        return np.zeros(len(raw))
    t, r = target + PRIOR, raw + PRIOR
    return np.log(t / t.sum()) - np.log(r / r.sum())


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.groupBy("doc_id").agg(F.max("quality").alias("q")).filter("q = 1 and doc_id is not null").select("doc_id")


OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, llr double"


def verdict(text: bytes, weight: np.ndarray, threshold: float) -> tuple:
    """The columns of OUT."""
    n, chars, symbols, dup, repeat = base_counts(text)
    failed = n < MIN_WORDS or 100 * repeat > 50 * n
    g = ngrams(text)
    llr = float(weight[g].mean()) if len(g) else 0.0
    return n, chars, symbols, dup, repeat, failed, not failed and llr >= threshold, llr


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, counts, verdict and llr of every document."""
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(*bucket_counts(docs, trusted_ids(labels))))
    names = ["doc_id", *(x.split()[0] for x in OUT.split(", "))]

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            rows = [verdict(t, ratios.value, threshold) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in zip(*rows))], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", utf8().alias("_t")).mapInArrow(work, f"doc_id {kind}, {OUT}")


def filtered(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are kept, with all their columns."""
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(*bucket_counts(docs, trusted_ids(labels))))
    at = docs.columns.index("text")

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, col=at):
            texts = b.column(at).cast(pa.binary())
            yield b.filter(pa.array([verdict(t.as_py() or b"", ratios.value, threshold)[6] for t in texts], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
