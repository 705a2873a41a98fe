"""Decontamination against a reference in plain Python."""

import random
import re

import corpus_pipeline
from pyspark.sql import functions as F

from pairloom.llm import decontam

W, SHARE = decontam.WINDOW, decontam.COVERAGE


def marked(text):
    """(template word, word with its value): names are runs of capitalised words, then numbers, then units after a number."""
    out = []
    name = r"(?<![^\W_])[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ][^\W\d_]*(?:[ \t-\r]+[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ][^\W\d_]*)*"
    number = r"[0-9]+(?:[.,:/][0-9]+)*"
    unit = rf"(?P<unit>{number}) ?(?P<of>(?i:{decontam.UNITS}))(?=[\W_]|$)"
    for m in re.finditer(rf"(?P<name>{name})|{unit}|(?P<number>{number})|[^\W_]+|[ \t-\r]+|[\W_]", text or ""):
        out.append(m)
    words, glued = [], False  # what isn't parted by blanks is one word
    for m in out:
        if re.fullmatch(r"[ \t-\r]+", m[0]):
            glued = False
            continue
        if m["name"]:
            new = [("N", "N" + re.sub(r"\s", "", m[0]).lower())]
        elif m["unit"]:
            new = [("0", "0" + re.sub(r"\D", "", m["unit"])), ("U", "U" + m["of"].lower())]
        elif m["number"]:
            new = [("0", "0" + re.sub(r"\D", "", m[0]))]
        elif re.fullmatch(r"[^\W_]+", m[0]):
            new = [(m[0].lower(), m[0].lower())]
        else:
            continue
        if glued and words:
            words[-1] = (words[-1][0] + new[0][0], words[-1][1] + new[0][1])
            words += new[1:]
        else:
            words += new
        glued = True
    return words


def is_found(doc, item):
    """Both rules, by trying every shift."""
    d, b = marked(doc), marked(item)
    k = min(W, len(b))
    if not b:
        return False
    t = {tuple(x[0] for x in b[i : i + k]): i for i in reversed(range(len(b) - k + 1))}
    raw = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)}
    held = {tuple(d[i : i + k]) for i in range(len(d) - k + 1)}
    if len({tuple(x[0] for x in w) for w in raw & held}) >= SHARE * len(t):
        return True
    if len(b) < W:
        return False
    telling = {w for w in t if sum(x[0] not in "N0U" for x in w) > 1}
    for shift in range(-len(b), len(d)):
        hit = {w for w, i in t.items() if 0 <= shift + i <= len(d) - k and tuple(x[0] for x in d[shift + i : shift + i + k]) == w}
        if not telling or len(hit) < SHARE * len(t) or len(hit & telling) < SHARE * len(telling):
            continue
        lo, hi = min(t[w] for w in hit), max(t[w] for w in hit) + W - 1
        pairs = {(b[i][1], d[i + shift][1]) for i in range(lo, hi + 1) if b[i][0] in "N0U" and d[i + shift][0] == b[i][0] and not (b[i][0] == "N" and i in (0, len(b) - 1))}
        if len({x for x, _ in pairs}) == len({y for _, y in pairs}) == len(pairs):
            return True
    return False


NAMES = ["John", "Mary Smith", "Peter", "Anna Jones", "Zoe", "Bob Lee", "Carl Otto Braun", "Ida", "Max Weber", "Tom"]
UNITS = ["km", "miles", "hours", "days", "kg", "grams", "dollars", "euros"]
PLAIN = "walk home before they give apples away while old birds sing near green rivers and many small houses stand there after rain for every long winter night".split()


def template(rng):
    """A question with numbered slots, beginning with a name now and then."""
    out = ["{n0}"] if rng.random() < 0.5 else []
    for _ in range(rng.randint(14, 30)):
        out.append(rng.choice(["{n%d}" % rng.randrange(3), "{x%d}" % rng.randrange(4), "{x%d} {u%d}" % (rng.randrange(4), rng.randrange(2))]) if rng.random() < 0.25 else rng.choice(PLAIN))
    # names that follow one another would be one run
    return " ".join(out).replace("} {n", "} and {n") + "."


def filled(t, rng):
    names, numbers, units = rng.sample(NAMES, 3), rng.sample(range(2, 900), 4), rng.sample(UNITS, 2)
    return t.format(**{f"n{k}": v for k, v in enumerate(names)}, **{f"x{k}": v for k, v in enumerate(numbers)}, **{f"u{k}": v for k, v in enumerate(units)})


def test_random_templates(spark):
    rng = random.Random(7)
    made = [template(rng) for _ in range(40)]
    items = [(k, filled(t, rng)) for k, t in enumerate(made)]
    docs, of = [], {}
    for k, t in enumerate(made):
        for how in range(4):
            text = filled(t, rng)
            if how == 1:
                text = "a short quiz follows here: " + text
            if how == 2:
                text = " ".join(rng.choice(PLAIN) for _ in range(40)) + ".\n" + text + " " + " ".join(rng.choice(PLAIN) for _ in range(40))
            if how == 3:
                text = items[k][1].replace("and", "or", 1) + " It goes on."
            of[len(docs)] = k
            docs.append((len(docs), text))
    for k, t in enumerate(made):  # each number another one: inconsistent where a slot comes twice
        text = re.sub(r"\{x\d\}", lambda m: str(rng.randrange(2, 900)), t)
        docs.append((len(docs), filled(text, rng)))
    docs += [(len(docs) + k, " ".join(rng.choice(PLAIN) for _ in range(60))) for k in range(20)]
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    pairs = {(r.doc_id, r.item_id) for r in got}
    assert pairs == {(d, i) for d, text in docs for i, item in items if is_found(text, item)}
    assert sum((d, k) in pairs for d, k in of.items()) >= 0.95 * len(of)
    assert not {d for d, _ in pairs if d >= len(docs) - 20}


def test_by_hand(spark):
    item = "John has 5 apples and gives 2 apples to Mary Smith before they walk home"
    other = item.replace("John", "Peter").replace("5", "9").replace("Mary Smith", "Anna Jones")
    numbers = "4 birds sit on a wall while 5 cats run and 6 dogs eat near 7 cows in a field"
    docs = [
        (1, other), (2, "A short quiz follows here: " + other), (3, item), (4, "A short quiz follows here: " + item + " again"),
        (5, re.sub("[4567]", "1", numbers)), (6, numbers.translate(str.maketrans("4567", "8239"))), (None, item), (None, "no leak without an id"),
        (8, "one text of this id " + item), (8, "and a clean one of the same id"), (9, None), (9, ""), (10, "of all that " * 3000), (11, (item + " ") * 300),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"id": F.lit(1), "th": F.lit("x"), "pos": F.lit(2)})
    bench = spark.createDataFrame([(0, item), (1, numbers), (None, "no id"), (3, None), (4, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.reparameterised for r in decontam.contaminated(df, bench).collect()}
    assert got == {(1, 0): True, (2, 0): True, (3, 0): False, (4, 0): False, (6, 1): True, (None, 0): False, (8, 0): False, (11, 0): False}
    clean = decontam.cleaned(df, bench)
    assert clean.columns == df.columns and sorted(map(str, (r.doc_id for r in clean.collect()))) == sorted(map(str, [5, None, 8, 9, 9, 10]))
    assert {(r.id, r.th, r.pos) for r in clean.collect()} == {(1, "x", 2)}


def test_hard_tables(spark, hard, nothing):
    bench = spark.createDataFrame([(1, "a second row of one id"), (2, "no id at all")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(hard, bench).collect()}
    assert got == {(7, 1), (None, 2)}
    assert sorted(map(str, (r.doc_id for r in decontam.cleaned(hard, bench).collect()))) == sorted(map(str, [0, 1, 2, 3, 4, 5, 6, 7, 9, 10]))
    for docs, items in ((nothing, bench), (hard, bench.limit(0))):
        assert decontam.contaminated(docs, items).count() == 0 and decontam.cleaned(docs, items).count() == docs.count()
