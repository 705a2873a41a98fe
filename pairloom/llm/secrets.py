"""Secret scans over an incremental blob ledger, in DataFrame expressions only.

Method. Every version of a document is a path that points at a blob, named by the SHA-256 of its text. The ledger has
one row a blob: the version of each rule it was scanned under, and what was found, both by the rules' kinds, so rules may be
added, dropped or reordered. A scan takes only blobs and rules whose pair is unseen; findings then go back to all paths by a join
on the blob. Texts are shuffled once, by blob, with copies dropped on the map side first, so a group of copies that holds a third
of all rows costs one row a task. The query fills its ledger in BATCHES of versions.

Matches become rows whose places add up over a window by blob and rule, and redacted texts are put together from blocks, so
a text with very many matches costs time in proportion.

Positions are code points, end exclusive. Defined cases: null text is the empty blob; rows repeat in the result as in
the input; a null path id is kept; empty tables give empty results; the input's other columns are dropped by ``report`` and kept,
whatever their names, by ``redacted``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import fresh, saved


@dataclass(frozen=True)
class Rule:
    """kind; pattern (Java); group whose length in code points must be least or more; hints: one of them is in the lower-cased text."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    hints: tuple[str, ...] = ()
    version: str = "1"


BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, ("passw", "secret", "token", "api")),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, ("akia",)),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
# A key's block up to its END line; where that is missing, its base64 lines (also as one line, or with escaped line ends).
_BREAK = r"(?:[\x20\x09\x0A\x0D]|\\[nr])"
_TO_END = r"[^-]*+(?:-(?!----)[^-]*+){0,64}+-----END [A-Z ]*PRIVATE KEY-----"
_LINES = rf"(?:{_BREAK}++[A-Za-z-]++:\x20[^\n\\]*+){{0,8}}+(?:(?:{_BREAK}++[A-Za-z0-9+/]{{16,}}+={{0,2}}+){{1,1000}}+(?:\x20*\r?\n[A-Za-z0-9+/]+={{0,2}}(?=\s*\n|\s*\z))?)?"
ADDED = (
    Rule("pem", rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:{_TO_END}|{_LINES})", hints=("private key-----",), version="2"),
    # at a run's start only, and without giving back, so that a long run is read once
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", hints=("eyj",), version="2"),
    Rule("ghtoken", r"gh[pousr]_[A-Za-z0-9]{36,}", hints=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", hints=("xox",)),
    Rule("urlcred", r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[A-Za-z0-9._%+-]{1,64}:[A-Za-z0-9._%+!$*-]{3,128}@", hints=("://",)),
)
RULES = BASE + ADDED
SPAN = "array<struct<start:bigint,kind:string,end:bigint>>"
LEDGER = f"blob string, seen map<string,string>, spans {SPAN}"
STEP = "array<struct<kind:string,i:int,gap:bigint,len:bigint,kept:boolean>>"
BATCHES = 2
#: Blobs with findings, and spans in them, up to which they are broadcast; beyond, the join shuffles.
BROADCAST_ROWS, BROADCAST_SPANS = 100_000, 1_000_000
#: Code points of a block of text.
BLOCK = 1024


def _none() -> Column:
    return F.array().cast(SPAN)


def _of(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda x: x["kind"] == kind)


def _kinds(rules: tuple[Rule, ...]) -> Column:
    return F.array(*[F.lit(r.kind) for r in rules])


def ordered(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The spans of these rules by start, then as the rules are listed."""
    kinds = _kinds(rules)
    own = F.filter(spans, lambda x: F.array_contains(kinds, x["kind"]))
    keyed = F.array_sort(F.transform(own, lambda x: F.struct(x["start"].alias("start"), F.array_position(kinds, x["kind"]).alias("rank"), x["kind"].alias("kind"), x["end"].alias("end"))))
    return F.transform(keyed, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))


def _may_hold(rule: Rule, low: Column, text: Column) -> Column:
    """False only where the rule finds nothing."""
    if not rule.hints:
        return text.rlike(rf"[0-9a-f]{{{rule.least}}}") if rule.kind == "hex" else F.lit(True)
    out = low.contains(rule.hints[0])
    for h in rule.hints[1:]:
        out = out | low.contains(h)
    return out


def _steps(rule: Rule, text: Column) -> Column:
    """Leftmost matches without overlap: what stands before each, its length, and whether it is kept or only takes its place."""
    pattern = rule.pattern
    if rule.kind == "hex":  # a run that is long enough is found alike, and far fewer are looked at
        pattern = rf"[0-9a-f]{{{rule.least},}}"
    whole, part = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group))
    between = F.split(text, pattern, -1)
    length = lambda x: F.char_length(x).cast("bigint")
    both = F.arrays_zip(between.alias("gap"), whole.alias("all"), part.alias("part"))  # what stands after the last match has none
    return F.transform(both, lambda x, i: F.struct(F.lit(rule.kind).alias("kind"), i.alias("i"), length(x["gap"]).alias("gap"), length(x["all"]).alias("len"), (F.char_length(x["part"]) >= rule.least).alias("kept"))).cast(STEP)


def _scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger rows of blobs: blob, text, and of blobs met before seen and spans."""
    text, low, kinds = F.col("text"), F.lower("text"), [r.kind for r in rules]
    steps = []
    for rule in rules:
        new = F.coalesce(F.col("seen")[rule.kind] != rule.version, F.lit(True))
        steps.append(F.when(new & _may_hold(rule, low, text), _steps(rule, text)).otherwise(F.array().cast(STEP)))
    current = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.version)])
    old = F.coalesce("seen", F.create_map().cast("map<string,string>"))
    # the blob itself is a row, which also holds what stays of former scans; its columns have names of their own, as lambdas would take an equal alias
    seen = F.map_concat(F.map_filter(old, lambda k, _: ~k.isin(kinds)), current)
    done = {r.kind: F.coalesce(F.col("seen")[r.kind] == r.version, F.lit(False)) for r in rules}
    stays = F.filter(F.coalesce("spans", _none()), lambda x: reduce(or_, [(x["kind"] == k) & same for k, same in done.items()], ~x["kind"].isin(kinds)))
    step = F.explode(F.concat(F.array(F.struct(F.lit(None).cast("string").alias("kind"), F.lit(0).alias("i"), F.lit(0).cast("bigint").alias("gap"), F.lit(0).cast("bigint").alias("len"), F.lit(False).alias("kept"))).cast(STEP), *steps))
    rows = blobs.select("blob", step.alias("x"), "seen", "spans").select("blob", "x.*", F.when(F.col("x.kind").isNull(), seen).alias("now"), F.when(F.col("x.kind").isNull(), stays).alias("stays"))
    end = F.sum(F.col("gap") + F.coalesce("len", F.lit(0))).over(Window.partitionBy("blob", "kind").orderBy("i"))
    span = F.when(F.col("kept"), F.struct((F.col("end") - F.col("len")).alias("start"), "kind", "end"))
    found = rows.withColumn("end", end).groupBy("blob").agg(F.first("now", True).alias("seen"), F.first("stays", True).alias("stays"), F.collect_list(span).cast(SPAN).alias("new"))
    return found.select("blob", "seen", F.array_sort(F.concat("stays", "new")).alias("spans"))


def versions_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """path, blob, text: one row a version."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("path"), F.sha2(text.cast("binary"), 256).alias("blob"), text.alias("text"))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows of the blobs of versions (path, blob, text) that have an unseen blob or rule version."""
    blobs = versions.select("blob", "text").dropDuplicates(["blob"])
    if ledger is None:
        blobs = blobs.select("blob", "text", F.lit(None).cast("map<string,string>").alias("seen"), F.lit(None).cast(SPAN).alias("spans"))
    else:
        known = F.lit(True)
        for r in rules:
            known = known & F.coalesce(F.col("seen")[r.kind] == r.version, F.lit(False))
        blobs = blobs.join(ledger, "blob", "left").filter(~known)
    return _scan(blobs, rules)


def updated(ledger: DataFrame | None, new: DataFrame) -> DataFrame:
    """The ledger with rows of new in place of older ones of the same blob."""
    return new if ledger is None else ledger.join(new.select("blob"), "blob", "left_anti").unionByName(new)


def filled(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, batches: int = BATCHES) -> DataFrame:
    """The ledger with all versions (path, blob, text), taken in batches as they would arrive."""
    for k in range(batches):
        some = versions.filter(F.pmod(F.xxhash64("path"), F.lit(batches)) == k)
        ledger = saved(updated(ledger, scan_unseen(some, ledger, rules)), "ledger")
    return ledger


def _bounded(hits: DataFrame, spans: str) -> DataFrame:
    """hits, marked for broadcast if blobs and spans are few."""
    rows, n = hits.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(spans)), F.lit(0))).first()
    return F.broadcast(hits) if rows <= BROADCAST_ROWS and n <= BROADCAST_SPANS else hits


def findings(paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of paths (path, blob) with its spans; a blob without findings has none."""
    hit = saved(ledger.select("blob", ordered(F.col("spans"), rules).alias("spans")).filter(F.size("spans") > 0), "hits")
    return paths.join(_bounded(hit, "spans"), "blob", "left").withColumn("spans", F.coalesce("spans", _none()))


def as_text(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def report(docs: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(id_col, counts of the base rules' spans, their digest and all spans, for every version; the new ledger)."""
    versions = versions_of(docs, id_col)
    new = filled(versions, ledger, rules)
    found = findings(versions.select("path", "blob"), new, rules)
    base = F.filter("spans", lambda x: x["kind"].isin([r.kind for r in BASE]))
    count = [F.size(_of(F.col("spans"), r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return found.select(F.col("path").alias(id_col), *count, F.sha2(as_text(base).cast("binary"), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans")), new


def _islands(ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, gaps: (from, to) of what stands before each span, overlapping spans as one, and after the last (to: null)."""
    rows = ledger.select("blob", F.explode(ordered(F.col("spans"), rules)).alias("x")).select("blob", "x.start", "x.end")
    by = Window.partitionBy("blob").orderBy("start", "end")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", before)
    rows = rows.withColumn("island", F.sum(F.coalesce(F.col("start") >= F.col("before"), F.lit(True)).cast("int")).over(by))
    whole = rows.groupBy("blob", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = F.array_sort(F.collect_list(F.struct("start", "end")))
    whole = whole.groupBy("blob").agg(spans.alias("s"))
    gaps = F.transform(F.sequence(F.lit(0), F.size("s")), lambda i: F.struct(F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get("s", i - 1)["end"]).alias("from"), F.get("s", i)["start"].alias("to")))
    return whole.select("blob", gaps.alias("gaps"))


def redacted(docs: DataFrame, ledger: DataFrame | None = None, mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with each found span (overlapping ones as one) replaced by mark in text, and n_chars counted anew where it is there."""
    key, of = fresh("blob", docs), fresh("gaps", docs)
    versions = versions_of(docs.withColumn(key, F.lit(None).cast("long")), key)
    new = filled(versions, ledger, rules, 1)
    hits = saved(_islands(new, rules).select(F.col("blob").alias(key), F.col("gaps").alias(of)), "hits")
    text = F.coalesce("text", F.lit(""))
    out = docs.withColumn(key, F.sha2(text.cast("binary"), 256)).join(_bounded(hits, of), key, "left")

    def piece(blocks: Column, x: Column) -> Column:
        first, end = F.floor(x["from"] / BLOCK).cast("int"), F.coalesce(x["to"], F.size(blocks).cast("bigint") * BLOCK)
        held = F.array_join(F.slice(blocks, first + 1, F.floor(end / BLOCK).cast("int") - first + 1), "")
        return F.substring(held, (x["from"] - first * BLOCK + 1).cast("int"), (end - x["from"]).cast("int"))

    # a list of one, so that the blocks are made once and not for each piece
    blocks = F.array(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0)))
    clean = F.get(F.transform(blocks, lambda b: F.array_join(F.transform(F.col(of), lambda x: piece(b, x)), mark)), F.lit(0))
    out = out.withColumn("text", F.when(F.col(of).isNotNull(), clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:  # of the new column: counted within its expression the length comes out wrong
        out = out.withColumn("n_chars", F.when(F.col(of).isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)
