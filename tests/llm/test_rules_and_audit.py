"""Quality rules and the filter audit against plain readings."""

import random
import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from orrery.llm import filter_audit, quality_rules
from orrery.llm.quality_rules import LEAST, RATES, REACH

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \t\n\x0b\x0c\r", "one", "#*$ %&| <>", "a b c d e f g h", "a b c d e f g h " * 2, "a " * 9, "a " * 500, "été \U0001f600 \x1c x", "l\nl\n\nl \nl", "x" * 100_000, "w1 w2 w3 w4 w5 w6 w7 w8 z w1 w2 w3 w4 w5 w6 w7 w8"]


def measured(text):
    text = text or ""
    words = SPACE.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(lines), len(covered))


def test_measures(spark):
    df = spark.createDataFrame([(k, t, "own") for k, t in enumerate(ODD)], "doc_id long, text string, n_words string")
    got = {r["doc_id"]: tuple(r)[1:] for r in quality_rules.measure(df).collect()}
    assert got == {k: measured(t) for k, t in enumerate(ODD)}


def quartiles(values):
    """Starts of the bins that hold the first and third quartile."""
    start = lambda x: x if x < 128 else x >> x.bit_length() - 7 << x.bit_length() - 7
    v = sorted(map(start, values))
    return v[-(-len(v) // 4) - 1], v[-(-3 * len(v) // 4) - 1]


def test_verdicts(spark):
    rng = random.Random(3)
    rows = []
    for k in range(700):
        lang, source = rng.choice(["en"] * 5 + ["de", None]), rng.choice(["hot"] * 3 + ["b", None])
        text = " ".join("".join(rng.choices("abcdefg", k=rng.randint(2, 9))) for _ in range(rng.randint(15, 60)))
        if k % 17 == 0:
            text = text.replace("a", "###")
        if k % 23 == 0:
            text = "\n".join([text] * 3)
        rows.append((k % 650, text, lang, source))
    rows += [(900 + k, t, "fr", "odd") for k, t in enumerate(ODD)]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")
    own = [dict(zip(names, measured(t), strict=True)) for _, t, _, _ in rows]
    rates = [{r: m[a] * k // m[b] for r, (a, k, b, _) in RATES.items() if m[b]} for m in own]
    want = []
    for (i, _, lang, source), m, x in zip(rows, own, rates, strict=True):
        bad = []
        for r, v in x.items():
            levels = ([y[r] for (_, _, p, q), y in zip(rows, rates, strict=True) if r in y and (lev > 1 or p == lang) and (lev > 0 or q == source)] for lev in range(3))
            # the size of a group is that of its largest rate
            sizes = [max(sum(s in y and (lev > 1 or p == lang) and (lev > 0 or q == source) for (_, _, p, q), y in zip(rows, rates, strict=True)) for s in RATES) for lev in range(3)]
            lev = next((k for k in range(2) if sizes[k] >= LEAST), 2)
            q1, q3 = quartiles(list(levels)[lev])
            spread = max(q3 - q1, RATES[r][3])
            if v > q3 + REACH * spread or r == "mean_length" and v < q1 - REACH * spread:
                bad.append(r)
        base = m["n_words"] < 20 or 100 * m["n_repeat_words"] > 30 * m["n_words"]
        want.append((i, base, sorted(bad), not base and not bad))
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, lang string, source string, kept string, _lang string").repartition(3)
    out = quality_rules.judge(df)
    assert {"_lang", "failed", "n_lines"} <= set(out.columns)
    got = [(r["doc_id"], r["base_failed"], r["failed"], r["kept"]) for r in out.collect()]
    assert sorted(got) == sorted(want)
    assert any(w[2] for w in want) and sum(w[3] for w in want) > 400
    good = quality_rules.keep_good(df)
    assert good.columns == df.columns and good.count() == sum(w[3] for w in want)
    assert quality_rules.judge(df.limit(0)).count() == 0


def test_no_python_in_rules(spark):
    df = spark.createDataFrame([(1, "a b", "en", "s")], "doc_id long, text string, lang string, source string")
    plan = quality_rules.judge(df)._jdf.queryExecution().toString() + quality_rules.measure(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|NestedLoop|Cartesian", plan)


def plain_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    docs = []
    for i, t, lang in rows:
        t = t or ""
        w = SPACE.findall(t)
        bad = {f for f, x in zip("ABCD", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), re.search("[#$%&*|]", t)), strict=True) if x}
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows):
            bad.add("E")
        docs.append((lang or "", bad, i is not None and i in good, i is not None and i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                failing = sum(f in d[1] for d in own)
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), failing - len(gone), sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("parts", [1, 512])
def test_audit(spark, monkeypatch, parts):
    monkeypatch.setattr(filter_audit, "PARTS", parts)
    rng = random.Random(7)
    rows = [(k, t, rng.choice(["en", None, "", "de"])) for k, t in enumerate(ODD)]
    for k in range(20, 80):
        words = [rng.choice(["Ab", "c", "d", "e|", "long"]) if rng.random() < 0.5 else f"w{rng.randint(0, 400)}" for _ in range(rng.choice([50, 260]))]
        rows.append((k, " ".join(words), rng.choice(["en", "fr"])))
    rows += [(90 + k, rows[20][1], "fr") for k in range(5)] + [(90, rows[20][1], "en"), (None, rows[20][1], "en"), (None, "", None)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 100, 2)] + [(20, 1, 0), (20, 0, 1), (None, 1, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, part string").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = filter_audit.audit(df, lab)
    got = {tuple(r)[:3]: tuple(r)[3:] for r in out.drop("filter").collect()}
    assert got == plain_audit(rows, labels)
    assert out.where(F.substring("filter_order", F.col("step"), F.lit(1)) != F.col("filter")).count() == 0
    assert filter_audit.audit(df.limit(0), lab).count() == 0
    assert filter_audit.audit(df, lab.limit(0)).agg(F.sum("good_lost")).first()[0] == 0
