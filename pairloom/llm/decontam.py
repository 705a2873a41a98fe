"""Benchmark decontamination by template canonicalisation, in DataFrame expressions only.

Method. Numbers, names (runs of capitalised words) and units become typed placeholders, the rest is lower-cased without
punctuation; a template depends on the words alone, not on what stands before them. Windows of WINDOW template words of all
documents are hash-joined with those of the benchmark. An alignment is an item laid over a document at one shift. An item is found

* re-parameterised, if along one alignment COVERAGE of its distinct windows are met, and of those with two plain words or more,
  and the values that fill its placeholders there are exchanged one to one: equal values of the item always meet equal ones in
  the document, and unlike values unlike ones. A name that begins or ends the item is not compared, as its run may go on outside;
* as it is, if COVERAGE of its distinct windows are met with their values, at any places. So edits that shift the rest lose nothing.

The windows of the benchmark are broadcast only up to BROADCAST_ROWS, else both sides are shuffled by hash. Texts move only for
documents that may hold an item, and there the values are rows that meet by document and place: nothing is compared in pairs.

Defined cases: a document is a distinct pair of id and text, so repeated rows are one, unlike texts of one id are several, and a null id is
as good as any; null or empty texts have no window; an item shorter than a window is one window of its own length, looked for at
every place, and found only with equal values, as so short a template tells little; items with equal values are one, those of equal
templates one class, both told by the smallest item_id; null item_ids are left out; an empty table on either side finds nothing; other columns of the
input, whatever their names, are dropped by ``contaminated`` and kept by ``cleaned``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import fresh, saved, small

WINDOW = 5
COVERAGE = 0.5
BROADCAST_ROWS = 200_000
BROADCAST_DOCS = 500_000
# Placeholders for number, name and unit, the mark that ends a kept value, and the one between words of a name.
NUMBER, NAME, UNIT, CLOSE, JOINT = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004"
# Units of measure after a number.
UNITS = (
    "km|kg|cm|mm|mg|ml|ms|min|mph|kph|mb|gb|tb|kb|hz|khz|mhz|ghz|kw|mw|kv|ft|lbs|lb|oz|usd|eur|percent|dollars|dollar|euros|euro|hours|hour|minutes|minute|"
    "seconds|second|days|day|weeks|week|months|month|years|year|miles|mile|meters|meter|metres|metre|litres|litre|liters|liter|grams|gram|feet|inches|inch|m|g|l|s|h|w|v"
)
SPACES = r"[\x20\x09-\x0D]+"
CAPITALISED = r"(?<![\p{L}\p{N}])\p{Lu}\p{Ll}\p{L}*+"


def _marked(text: Column, keep: bool) -> Column:
    """text in template form; keep: with the values that were replaced."""
    name, number, unit = (f"{NAME}$0{CLOSE}", f"{NUMBER}$0{CLOSE}", f"$1 {UNIT}$2{CLOSE}$3") if keep else (NAME, NUMBER, f"$1 {UNIT}$3")
    end = CLOSE if keep else NUMBER
    # a run of capitalised words is one name, wherever it stands
    out = F.regexp_replace(text, rf"({CAPITALISED}){SPACES}(?=\p{{Lu}}\p{{Ll}})", f"$1{JOINT}")
    out = F.regexp_replace(out, rf"(?<![\p{{L}}\p{{N}}{JOINT}])\p{{Lu}}\p{{Ll}}\p{{L}}*+(?:{JOINT}\p{{Lu}}\p{{Ll}}\p{{L}}*+)*+", name)
    out = F.regexp_replace(out, r"[0-9]+(?:[.,:/][0-9]+)*", number)
    out = F.lower(F.regexp_replace(out, rf"({end}) ?((?i:{UNITS}))([^\p{{L}}\p{{N}}]|$)", unit))
    return F.regexp_replace(out, rf"[^\p{{L}}\p{{N}}{NUMBER}-{CLOSE}\x20\x09-\x0D]+", "")


def words(text: Column, keep: bool = False) -> Column:
    return F.filter(F.split(_marked(F.coalesce(text, F.lit("")), keep), SPACES), lambda w: w != "")


def _hashes(tokens: Column, k: int) -> Column:
    """Hashes of the windows of k words in order."""
    return F.when(F.size(tokens) >= k, F.transform(F.sequence(F.lit(1), F.size(tokens) - (k - 1)), lambda i: F.xxhash64(F.slice(tokens, i, k)))).otherwise(F.array().cast("array<bigint>"))


def _own(tokens: Column) -> Column:
    """An item's windows: one, if it is shorter than WINDOW."""
    return F.when(F.size(tokens) < WINDOW, F.array(F.xxhash64(tokens))).otherwise(_hashes(tokens, WINDOW))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """class_id, item_id, tokens, kept: distinct items (kept: their words with values), and the class of those with equal templates."""
    known = benchmark.filter("item_id is not null").select("item_id", words(F.col("text")).alias("tokens"), words(F.col("text"), True).alias("kept")).filter(F.size("tokens") > 0)
    items = known.groupBy("tokens", "kept").agg(F.min("item_id").alias("item_id"))
    return saved(items.join(items.groupBy("tokens").agg(F.min("item_id").alias("class_id")), "tokens").select("class_id", "item_id", "tokens", "kept"), "items")


def templates(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(class_id, n_windows, n_telling; h, class_id, wpos, telling): sizes of the classes, and their distinct windows by first place."""
    rows = items.filter("item_id = class_id").select("class_id", "tokens", F.posexplode(_own(F.col("tokens"))).alias("wpos", "h"))
    plain = F.size(F.filter(F.slice("tokens", F.col("wpos") + 1, WINDOW), lambda w: ~w.rlike(f"[{NUMBER}-{UNIT}]")))
    telling = ((plain > 1) & (F.size("tokens") >= WINDOW)).cast("int")
    rows = saved(rows.select("h", "class_id", "wpos", telling.alias("telling")).groupBy("h", "class_id").agg(F.min("wpos").alias("wpos"), F.first("telling").alias("telling")), "benchmark")
    return saved(rows.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_windows"), F.sum("telling").alias("n_telling")), "classes"), rows


def _told(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, id, th: two columns that tell a document and are never null."""
    return docs.select("doc_id", *_keys(), *more)


def _keys() -> tuple[Column, Column]:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.xxhash64(F.col("doc_id").isNull(), F.col("text")).alias("th")


KEY = ["id", "th"]


def matches(docs: DataFrame, windows: DataFrame, short: list[int]) -> DataFrame:
    """doc_id, id, th, class_id, wpos, shift, telling: each place of a document that holds a benchmark window. short: lengths of the items below WINDOW."""
    tokens = _told(docs, words(F.col("text")).alias("tokens"))
    found = tokens.select("doc_id", *KEY, F.posexplode(_hashes(F.col("tokens"), WINDOW)).alias("pos", "h"))
    for k in short:
        found = found.unionByName(tokens.select("doc_id", *KEY, F.posexplode(_hashes(F.col("tokens"), k)).alias("pos", "h")))
    return found.join(small(windows, BROADCAST_ROWS), "h").select("doc_id", *KEY, "class_id", "wpos", (F.col("pos") - F.col("wpos")).alias("shift"), "telling")


def _sound(aligned: DataFrame, items: DataFrame, own: DataFrame) -> DataFrame:
    """The alignments (KEY, class_id, shift, lo, hi, ...) whose values are exchanged one to one; n_slots, other (whether a value differs)."""
    last = F.size("kept") - 1
    slots = items.filter("item_id = class_id").select("class_id", last.alias("last"), F.posexplode("kept").alias("at", "b")).filter(F.col("b").contains(CLOSE))
    slots = slots.filter(~(F.col("b").contains(NAME) & F.col("at").isin(0, F.col("last")))).select("class_id", "at", "b")
    values = own.select(*KEY, F.posexplode("own").alias("pos", "d")).filter(F.col("d").contains(CLOSE))
    laid = aligned.select(*KEY, "class_id", "shift", "lo", "hi").join(slots, "class_id").filter("at between lo and hi").withColumn("pos", F.col("at") + F.col("shift"))
    met = laid.join(values, [*KEY, "pos"]).filter(F.substring("b", 1, 1) == F.substring("d", 1, 1))
    of = [F.size(F.collect_set(c)) for c in ("b", "d", F.struct("b", "d"))]  # of the item's slots, however long the document
    met = met.groupBy(*KEY, "class_id", "shift").agg(of[0].alias("n_slots"), of[1].alias("_d"), of[2].alias("_both"), F.max((F.col("b") != F.col("d")).cast("int")).alias("other"))
    both = aligned.join(met, [*KEY, "class_id", "shift"], "left")
    return both.filter("n_slots is null or (n_slots = _d and n_slots = _both)").withColumns({"n_slots": F.coalesce("n_slots", F.lit(0)), "other": F.coalesce("other", F.lit(0))})


def _literal(items: DataFrame, own: DataFrame, short: list[int]) -> DataFrame:
    """KEY, class_id, item_id, n: how many of an item's distinct windows a document holds with their values."""
    both = F.arrays_zip(_own(F.col("kept")).alias("v"), _own(F.col("tokens")).alias("h"))
    raw = items.select("class_id", "item_id", F.explode(both).alias("x")).select("class_id", "item_id", "x.v", "x.h").distinct()
    v = own.select(*KEY, F.explode(_hashes(F.col("own"), WINDOW)).alias("v"))
    for k in short:
        v = v.unionByName(own.select(*KEY, F.explode(_hashes(F.col("own"), k)).alias("v")))
    return v.join(small(saved(raw, "raw"), BROADCAST_ROWS), "v").select(*KEY, "class_id", "item_id", "h").distinct().groupBy(*KEY, "class_id", "item_id").agg(F.count(F.lit(1)).alias("n"))


def found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, id, th, item_id, coverage, n_windows, n_slots, reparameterised: each class of items found in a document."""
    items = benchmark_items(benchmark)
    sizes, windows = templates(items)
    short = sorted(r[0] for r in items.filter(F.size("kept") < WINDOW).select(F.size("kept")).distinct().collect())
    met = saved(matches(docs, windows, short), "matches").distinct()
    sizes = small(sizes, BROADCAST_ROWS)
    # an alignment has each window once, as windows are told by their first place in the item
    aligned = met.groupBy("doc_id", *KEY, "class_id", "shift").agg(F.count(F.lit(1)).alias("n"), F.sum("telling").alias("telling"), F.min("wpos").alias("lo"), (F.max("wpos") + WINDOW - 1).alias("hi"))
    aligned = saved(aligned.join(sizes, "class_id").filter((F.col("n_telling") > 0) & (F.col("n") >= COVERAGE * F.col("n_windows")) & (F.col("telling") >= COVERAGE * F.col("n_telling"))), "alignments")
    anywhere = met.select("doc_id", *KEY, "class_id", "wpos").distinct().groupBy("doc_id", *KEY, "class_id").agg(F.count(F.lit(1)).alias("n"))
    anywhere = saved(anywhere.join(sizes, "class_id").filter(F.col("n") >= COVERAGE * F.col("n_windows")).select("doc_id", *KEY, "class_id", "n_windows"), "anywhere")
    wanted = saved(anywhere.select(*KEY).distinct(), "wanted")  # alignments that suffice are among them
    own = saved(_told(docs, F.col("text")).join(small(wanted, BROADCAST_DOCS), KEY, "left_semi").dropDuplicates(KEY).select(*KEY, words(F.col("text"), True).alias("own")), "own")
    as_is = anywhere.join(_literal(items, own, short), [*KEY, "class_id"]).filter(F.col("n") >= COVERAGE * F.col("n_windows"))
    other = _sound(aligned, items, own)
    columns = ["doc_id", *KEY, "class_id", "n", "n_windows"]
    both = as_is.select(*columns, F.lit(0).alias("n_slots"), F.lit(0).alias("other")).unionByName(other.select(*columns, "n_slots", "other"))
    out = both.groupBy(*KEY, "class_id").agg(F.max("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("n_windows").alias("n_windows"), F.max("n_slots").alias("n_slots"), F.min("other").alias("other"))
    return out.select("doc_id", *KEY, F.col("class_id").alias("item_id"), (F.col("n") / F.col("n_windows")).alias("coverage"), F.col("n_windows").cast("long").alias("n_windows"), F.col("n_slots").cast("long").alias("n_slots"), (F.col("other") > 0).alias("reparameterised"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, coverage, n_windows, n_slots, reparameterised: each item found in a document."""
    return found(docs, benchmark).drop(*KEY)


def cleaned(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows in which no item is found, with their columns."""
    leaks = saved(found(docs, benchmark).select(*KEY).distinct(), "leaks")
    names = [fresh(k, docs) for k in KEY]
    leaks = leaks.select(*[F.col(k).alias(n) for k, n in zip(KEY, names)])
    return docs.withColumns(dict(zip(names, _keys()))).join(small(leaks, BROADCAST_DOCS), names, "left_anti").select(docs.columns)
