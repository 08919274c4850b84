"""Nulls, empty and very long values, ties, repeats, empty tables and clashing names, operator by operator."""

import gzip
import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from orrery.llm import bpe, embedding_dedup, mixing, nearest, ngram_join, quality, substring_dedup, token_store, toxicity, warc
from orrery.llm.components import components
from orrery.llm.queries import MIX_WEIGHTS
from orrery.llm.scratch import Scratch

PARA = " ".join(f"word{i}" for i in range(60))
SCHEMA = "doc_id long, text string, lang string, source string, rep long, token string, score string, _spans string, doc string, epochs string, cut string, _gone string"
BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, PARA, "en", "a"),
        (2, PARA.upper(), "en", "a"),
        (3, None, "en", None),
        (4, "", None, "b"),
        (5, " \t\n ", "de", "b"),
        (6, PARA + " extra", "de", "b"),
        (6, PARA + " extra", "de", "b"),
        (None, PARA, "fr", "c"),
        (7, "one two", "fr", "c"),
        (8, "ONE TWO", "fr", "c"),
        (9, "very long " * 30_000, "en", "a"),
        (10, "x" * 200_000, "en", "a"),
        (11, "été \U0001f600 naïve b \x1c c", "fr", "c"),
    ]
    return spark.createDataFrame([(*r, 0, "t", "s", "p", "d", "e", "c", "g") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_ngram_join(odd, none):
    got = {}
    for r in ngram_join.jaccard_components(odd).collect():
        got.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"]))
    assert got[1] == [(56, 1)] and got[2] == [(56, 1)] and got[6] == [(57, 1)] * 2
    assert got[3] == [(0, 3)] and got[4] == [(0, 4)] and got[5] == [(0, 5)]
    assert got[7] == [(1, 7)] and got[8] == [(1, 7)] and got[None] == [(56, None)]
    assert got[9] == [(2, 9)] and got[10] == [(1, 10)]
    assert ngram_join.jaccard_components(none).count() == 0
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 7, 9, 10, 11]


@pytest.mark.parametrize(("block", "rounds"), [(3, 2), (512, 2), (3, 0), (512, 1)])
def test_ngram_links_equal_all_pairs(spark, block, rounds):
    rng = np.random.RandomState(block)
    rows = []
    for g in range(8):
        words = [f"w{x}" for x in rng.randint(0, 3000, rng.randint(5, 120))]
        for _ in range(rng.randint(1, 12)):
            v = list(words)
            for _ in range(rng.randint(0, 4)):
                v[rng.randint(len(v))] = f"e{rng.randint(9999)}"
            rows.append((len(rows), " ".join(v) + (" common tail of words here" if g % 2 else "")))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    up = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and up[i] != up[j]:
                    up[i] = up[j] = min(up[i], up[j])
                    changed = True
    got = ngram_join.jaccard_components(df, sketch_bits=16, block=block, hot_level=3, rounds=rounds).toPandas().sort_values("doc_id")
    assert got.component_id.tolist() == up and got.n_shingles.tolist() == [len(s) for s in sets]


def test_ngram_join_of_ids_with_different_texts(spark):
    """Rows of one id share its component, which joins what their texts link with."""
    text = [" ".join(f"{p}{i}" for i in range(30)) for p in "abcd"]
    rows = [(3, text[1]), (5, text[0]), (5, text[1]), (7, text[0]), (7, text[2]), (9, text[2]), (11, text[3]), (11, None)]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(3, 3), (5, 3), (5, 3), (7, 3), (7, 3), (9, 3), (11, 11), (11, 11)]


def test_links_of_a_tile_span_all_of_them():
    """Against all pairs, with near copies so that overlaps are derived."""
    rng = np.random.RandomState(8)
    found = 0
    for trial in range(300):
        base = rng.choice(400, 60, replace=False)
        far = np.r_[base[: rng.randint(44, 60)], rng.choice(np.arange(400, 800), rng.randint(1, 8), replace=False)]

        def near(x, n):
            return np.unique(np.r_[x[rng.rand(len(x)) > 0.04], rng.randint(0, 3000, rng.randint(0, 4))]).astype(np.uint64)

        xs = [near(base, 60) for _ in range(rng.randint(1, 9))]
        ys = [near(far, 60) for _ in range(rng.randint(1, 9))]
        every = {(i, j) for i, x in enumerate(xs) for j, y in enumerate(ys) if 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))}
        hit = ngram_join.links(xs, ys, 80, 100)
        assert set(hit) <= every and len(set(hit)) == len(hit)
        graph = [list(range(len(xs) + len(ys))) for _ in range(2)]
        for up, pairs in zip(graph, (hit, every), strict=True):
            for _ in range(len(up)):
                for i, j in pairs:
                    up[i] = up[len(xs) + j] = min(up[i], up[len(xs) + j])
        assert graph[0] == graph[1]
        found += bool(every)
    assert 30 < found < 270


def test_substring_dedup(odd, none):
    out = substring_dedup.remove_repeats(odd)
    assert out.columns == [*odd.columns, "kept_text", "n_words", "n_removed"]
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append((r["n_words"], r["n_removed"], r["kept_text"]))
    assert got[1] == [(60, 0, PARA)] and got[2][0][1] == 0
    assert got[6] == [(61, 60, "extra")] * 2 and got[None] == [(60, 60, "")]
    assert got[3] == got[4] == got[5] == [(0, 0, "")]
    n, gone, text = got[9][0]
    # windows of the repeated phrase start at two distinct words; all later ones repeat them
    assert n == 60_000 and text.split() == ["very", "long"][: n - gone] and gone == 59_998
    assert substring_dedup.remove_repeats(none).count() == 0


def test_substring_dedup_of_a_phrase_in_many_contexts(spark):
    """A frequent phrase is no minimiser, so its contexts do not meet in one bucket; results stay those of brute force."""
    rng = np.random.RandomState(6)
    tk = substring_dedup.tk
    tries = [f"here is that frequent phrase{i}" for i in range(400)]
    code = [tk.rolling(next(tk.runs(substring_dedup.pa.array([t])))[1].hash, 5)[0] for t in tries]
    phrase = tries[int(np.argmin(code))].split() + ["again"]  # one that would often be least
    texts = [" ".join([*(f"a{x}" for x in rng.randint(0, 10**6, 25)), *phrase, *(f"b{x}" for x in rng.randint(0, 10**6, 25))]) for _ in range(900)]
    texts += texts[:5] + [" ".join(t.split()[10:50]) for t in texts[5:10]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = substring_dedup.remove_repeats(docs).orderBy("doc_id").toPandas()
    assert (got.n_removed[:900] == 0).all() and got.n_removed[900:905].tolist() == [56] * 5 and got.n_removed[905:].tolist() == [40] * 5
    gram = substring_dedup._gram_counts(5, 16)
    table = substring_dedup.slots.heavy(docs.select("text").mapInArrow(gram, substring_dedup.slots.SCHEMA), 16, 2.0**-11, 500)
    least = []
    for frequent in (table, np.zeros_like(table)):
        counts = Counter()
        for _, w in tk.runs(substring_dedup.pa.array(texts)):
            counts.update(substring_dedup._windows(w, np.arange(len(texts)), 20, 5, frequent)[3].tolist())
        least.append(counts.most_common(1)[0][1])
    assert least[0] < 60 and least[1] > 900


@pytest.mark.parametrize("splits", [("apart", "joined"), ("joined", "apart")])
def test_substring_dedup_with_other_splits_in_each_pass(spark, tmp_path, monkeypatch, splits):
    """The second pass may read the files in other partitions than the first."""
    rng = np.random.RandomState(2)
    word = lambda n: [f"v{j}" for j in rng.randint(0, 10**6, n)]
    shared = word(80)
    texts = [word(30) + shared[a : a + n] + word(30) for a, n in ((0, 60), (10, 60), (20, 60), (0, 80), (5, 40), (30, 50))]
    for i, t in enumerate(texts):
        spark.createDataFrame([(i, " ".join(t))], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path))
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old, table = {k: spark.conf.get(k, None) for k in keys}, substring_dedup.slots.bit_table

    def split(how):
        for k, v in zip(keys, ("1m", "1m", "1") if how == "apart" else ("128m", "0", "1"), strict=True):
            spark.conf.set(k, v)

    def between(*args):
        out = table(*args)
        split(splits[1])
        return out

    monkeypatch.setattr(substring_dedup.slots, "bit_table", between)
    try:
        split(splits[0])
        docs = spark.read.schema("doc_id long, text string").parquet(str(tmp_path))
        parts = docs.rdd.getNumPartitions()
        got = {r["doc_id"]: r["kept_text"] for r in substring_dedup.remove_repeats(docs).collect()}
        assert parts == (6 if splits[0] == "apart" else 1) and docs.select("*").rdd.getNumPartitions() == 7 - parts
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    seen, want = set(), {}
    for i, t in enumerate(texts):
        gone = set()
        for j in range(len(t) - 19):
            gone.update(range(j, j + 20) if tuple(t[j : j + 20]) in seen else ())
            seen.add(tuple(t[j : j + 20]))
        want[i] = " ".join(x for j, x in enumerate(t) if j not in gone)
    assert got == want


def test_mixing(odd, none, spark):
    out = mixing.mix(odd, MIX_WEIGHTS, max_epochs=3)
    assert out.columns == [*odd.columns, "mix_domain", "mix_lang", "mix_source", "n_tokens", "copies"]
    assert out.where("copies < 1 or copies > 3").count() == 0
    assert mixing.mix(none, MIX_WEIGHTS).count() == 0
    leaves = spark.createDataFrame([("a", "x", 100), ("a", "y", 1000), ("b", "z", 1000)], "d string, l string, tokens long")
    got = {r["l"]: r["target"] for r in mixing.budgets(leaves, ["d", "l"], [{"a": 1, "b": 1}, {"x": 9, "y": 1}], 1000, 1).collect()}
    assert got == {"x": 100, "y": 400, "z": 500}  # x is short: its sibling takes the rest
    got = {r["l"]: r["target"] for r in mixing.budgets(leaves, ["d", "l"], [{"a": 9, "b": 1}, {}], 2000, 1).collect()}
    assert got == {"x": 100, "y": 1000, "z": 900}  # a is short as a whole: b takes the rest
    got = {r["l"]: r["target"] for r in mixing.budgets(leaves, ["d", "l"], [{"b": 0}, {}], 1500, 1).collect()}
    assert got == {"x": 100, "y": 1000, "z": 0}


def test_bpe(odd, none):
    out = bpe.encode_decode(odd, BYTE)
    assert out.count() == odd.count() and out.where("decoded <> coalesce(text, '')").count() == 0
    assert bpe.digests(none, BYTE).count() == 0
    empty = hashlib.sha256(b"").hexdigest()
    assert bpe.digests(odd, BYTE).where("doc_id in (3, 4)").where(f"n_tokens = 0 and ids_sha256 = '{empty}'").count() == 2


def test_token_store(odd, none, spark):
    for df, n in ((odd, odd.count()), (none, 0)):
        path = Scratch(spark, "t").path("store")
        token_store.write(df, path, WORD, end_id=2)
        got = token_store.with_crc(token_store.read(spark, path)).toPandas()
        assert len(got) == n and token_store.verify(spark, path)
    got = got if n else token_store.with_crc(token_store.read(spark, path)).toPandas()
    path = Scratch(spark, "t").path("store")
    token_store.write(odd, path, WORD, end_id=2, vocab=1 << 17)  # four bytes an id, texts whole
    wide = token_store.with_crc(token_store.read(spark, path)).toPandas().sort_values("start")
    assert wide.start.tolist() == [0, *np.cumsum(wide.n_tokens)[:-1].tolist()] and np.isnan(wide.doc_id.iloc[0])
    stored = spark.read.parquet(f"{path}/documents").where("doc_id = 9").first()
    assert sum(np.frombuffer(stored["sizes"], "<u2")) == stored["n_tokens"]


def test_chunks_move_with_the_text():
    ids = np.random.RandomState(1).randint(0, 49_000, 20_000).astype("<u4")
    a, b = token_store.cuts(ids), token_store.cuts(np.concatenate([ids[:7], ids]))
    ea, eb = set(np.cumsum(a).tolist()), {x - 7 for x in np.cumsum(b).tolist()}
    assert len(ea & eb) > 0.9 * len(ea) and a.max() <= token_store.MOST and a.sum() == 20_000


def page_rows():
    big = "<p>" + "x" * 200 + "</p>"
    return [(5, "http://www.Example.com/a?q=1#f", big, 0), (3, "https://example.com:443/a?q=1", big, 0), (9, None, big, 0), (None, "http://e.org", big, 0), (1, "http://b.org/\tx", None, 0), (2, "", "", 0), (4, "not a url [", "short", 0), (6, "http://c.org:8080/", "short", 0), (7, "http://d.org/", "é" * 100_000, 0)]


def test_warc(spark):
    df = spark.createDataFrame(page_rows(), "page_id long, url string, html string, digest int")
    path = Scratch(spark, "t").path("warc")
    warc.write(df, path)
    got = {r["page_id"]: r for r in warc.read(spark, path).collect()}
    assert got[3]["record_type"] == "response" and {got[i]["refers_to"] for i in (5, 9)} == {3}
    assert got[None]["record_type"] == "response" and got[4]["record_type"] == got[6]["record_type"] == "response"
    assert got[1]["payload_bytes"] == 0 and got[7]["payload_bytes"] == 200_000 and got[5]["payload"] is None
    index = warc.Index(spark, path)
    found = index.lookup("HTTP://example.com/a?q=1")
    assert sorted(f["X-Page-Id"] for f, _ in found) == ["3", "5"] and index.lookup("http://nowhere.org/") == []
    assert warc.url_key("https://www.A.b.org:8443/P?x#y") == "org,b,a:8443)/p?x"
    want = spark.createDataFrame([("example.com/a?q=1", 5), ("http://b.org/ x", 1), (None, 9), ("http://b.org/ x", 2), ("http://zz.org", 1), ("not a url [", 4)], "url string, page_id long")
    assert sorted(r["page_id"] for r in warc.find(spark, path, want).collect()) == [1, 4, 5, 9]
    whole = {r["page_id"]: tuple(r) for r in warc.resolve(spark, path, warc.read(spark, path)).collect()}
    assert all(whole[i] == (i, len(page_rows()[0][2]), got[3]["payload_digest"], "revisit", 3) for i in (5, 9)) and len(whole) == 9
    path = Scratch(spark, "t").path("warc")
    warc.write(df.limit(0), path)
    assert warc.read(spark, path).count() == 0 and warc.find(spark, path, want).count() == 0
    raw = gzip.decompress(warc.record(1, "u", b"pay", "d", "response", None))
    assert raw.startswith(b"WARC/1.1\r\n") and warc.parse(warc.record(1, "u", b"pay", "d", "response", None))[1] == b"pay"


def test_warc_lookups_over_many_blocks(spark):
    """Equal keys over blocks and files, against the rows themselves."""
    rows = [(i, f"http://h{i % 7}.org/{'same' if i % 3 else i}", f"{i % 40} " * 60) for i in range(3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    path = Scratch(spark, "t").path("warc")
    warc.write(df, path, index_rows=700)
    asked = [(u, i) for i, u, _ in rows if i % 11 == 0] + [("http://h1.org/none", 1), ("http://h1.org/same", 10**9)]
    got = warc.find(spark, path, spark.createDataFrame(asked, "url string, page_id long")).toPandas()
    assert sorted(got.page_id) == list(range(0, 3000, 11))
    index = warc.Index(spark, path)
    assert sorted(int(f["X-Page-Id"]) for f, _ in index.lookup("http://h1.org/same")) == [i for i, u, _ in rows if u == "http://h1.org/same"]


def test_warc_of_a_task_that_runs_twice(spark):
    """Two attempts leave two files; what is read is the one that the committed rows name."""
    path = Scratch(spark, "t").path("warc")
    df = spark.createDataFrame([(i, f"http://a.org/{i}", "x" * (200 + i)) for i in range(30)], "page_id long, url string, html string").coalesce(1)
    run = warc._writer(f"{path}/archive")
    other = df.orderBy(F.desc("page_id")).selectExpr("page_id", "url", "html", "sha2(html, 256)", "cast(null as long)", "cast(null as string)").coalesce(1)
    assert other.mapInArrow(run, warc._CAPTURE).count() == 30  # an attempt whose rows are lost, in another order
    warc.write(df, path)
    got = warc.resolve(spark, path, warc.read(spark, path)).toPandas()
    assert sorted(got.page_id) == list(range(30)) and (got.payload_bytes == 200 + got.page_id).all()


def vector_rows():
    rng = np.random.RandomState(2)
    base = rng.randn(60, 8)
    base[20:40] = base[:20] + 0.05 * rng.randn(20, 8)
    base[40:45] = base[0]
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(base.astype(np.float32))]
    return rows + [(60, None, 0), (61, [], 0), (62, [0.0] * 8, 0), (63, [float("nan")] + [1.0] * 7, 0), (64, [None] + [1.0] * 7, 0), (65, [1.0] * 5, 0), (None, [1.0] * 8, 0), (66, [float("inf")] + [1.0] * 7, 0)]


VEC = "vec_id long, embedding array<float>, cell int"


@pytest.mark.parametrize("block", [7, 2048])
def test_embedding_dedup(spark, block):
    df = spark.createDataFrame(vector_rows(), VEC)
    got = {r["vec_id"]: tuple(r)[1:] for r in embedding_dedup.dedup(df, 0.95, block=block).collect()}
    x = np.array([v for i, v, _ in vector_rows()[:60]], np.float32).astype(float)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = (u @ u.T >= 0.95) & ~np.eye(60, dtype=bool)
    comp = np.arange(60)
    for _ in range(60):
        comp = np.minimum(comp, np.where(link, comp[None], 99).min(1))
    for i in range(60):
        assert got[i] == (link[i].sum(), comp[i], comp[i] == i)
    assert all(got[i] == (0, i, True) for i in range(60, 67)) and got[None] == (0, None, None)
    assert embedding_dedup.dedup(df.limit(0)).count() == 0


def test_nearest(spark):
    df = spark.createDataFrame(vector_rows(), VEC)
    got = nearest.search(df, df.where("vec_id % 5 = 0 or vec_id > 58"), k=6, query_rows=3, vector_rows=7).toPandas()
    x = np.array([v for _, v, _ in vector_rows()[:60]], np.float32).astype(float)
    for q in range(0, 60, 5):
        s = [(-sum((a * b for a, b in zip(x[q], x[j], strict=True)), 0.0), j) for j in range(60) if j != q]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine.vec_id.tolist() == [j for _, j in sorted(s)[:6]] and mine.score.tolist() == [-a for a, _ in sorted(s)[:6]]
    assert set(got.query_id) == {*range(0, 60, 5), 59}
    few = df.where("vec_id < 3")
    assert nearest.search(few, few, k=20).count() == 6
    assert nearest.search(df.limit(0), df.limit(0)).count() == 0


def extreme_rows():
    """Very small, very large and mixed components, other lengths, and repeated ids."""
    rng = np.random.RandomState(4)
    base = rng.randn(6, 4)
    rows = [(i, base[i]) for i in range(6)]
    rows += [(10 + i, base[i] * 1e-170) for i in range(3)] + [(20 + i, base[i] * 1e200) for i in range(3)]
    rows += [(30, np.array([1e200, 1e-200, 0, 0])), (31, np.array([1e-200, 0, 0, 0]))]
    other = rng.randn(7)
    rows += [(40, other), (41, other * 2), (42, -other), (43, other[:6])]
    rows += [(50, base[5] + 0.01)] * 40 + [(51, base[5])] * 3 + [(51, base[0])] * 2
    return [(i, [float(z) for z in v]) for i, v in rows]


@pytest.mark.parametrize("block", [5, 8192])
def test_embedding_dedup_of_extreme_vectors(spark, block):
    rows = extreme_rows()
    got = {r["vec_id"]: tuple(r)[1:] for r in embedding_dedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.95, block=block).collect()}
    unit = [(i, np.array(v) / max(map(abs, v))) for i, v in rows]
    unit = [(i, v / np.linalg.norm(v)) for i, v in unit]
    ids = sorted({i for i, _ in rows})
    n, comp = dict.fromkeys(ids, 0), {i: i for i in ids}
    pairs = [(i, j) for i, u in unit for j, v in unit if i != j and len(u) == len(v) and u @ v >= 0.95]
    for i, _ in pairs:
        n[i] += 1
    for _ in ids:
        for i, j in pairs:
            comp[i] = min(comp[i], comp[j])
    assert got == {i: (n[i], comp[i], comp[i] == i) for i in ids}


@pytest.mark.parametrize("rows_to_a_tile", [3, 8192])
def test_nearest_of_extreme_vectors(spark, rows_to_a_tile):
    rows = extreme_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest.search(df, df, k=4, query_rows=rows_to_a_tile, vector_rows=rows_to_a_tile).orderBy("query_id", "rank").collect()
    want = []
    for q in sorted({i for i, _ in rows}):
        best = {}
        for i, u in rows:
            for j, v in rows:
                if i == q and j != q and len(u) == len(v):
                    s = 0.0
                    for a, b in zip(u, v, strict=True):
                        s += a * b
                    best[j] = max(best.get(j, -np.inf), -np.inf if np.isnan(s) else s)
        want += [(q, k + 1, j, s) for k, (j, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:4])]
    assert [tuple(r) for r in got] == want


def test_toxicity(odd, none, spark):
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1), (6, 0)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    out = toxicity.score(odd, model)
    assert out.columns == [c for c in odd.columns if c != "score"] + ["score", "predicted"]
    assert out.where("score is null or score < 0 or score > 1 or predicted = 1").count() == 0
    bad = spark.createDataFrame([(1, "you idiot, you moron and pathetic scum")], "doc_id long, text string")
    assert toxicity.score(bad, model).first()["predicted"] == 1
    assert toxicity.score(none, toxicity.fit(none, labels.limit(0))).count() == 0
    kept = toxicity.reject_toxic(odd, labels)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_label_model_tells_good_voters():
    rng = np.random.RandomState(3)
    y = rng.rand(4000) < 0.2
    v = np.stack([np.where(rng.rand(4000) < a, y, ~y) for a in (0.9, 0.85, 0.8, 0.55)], 1)
    v = np.c_[v, v[:, 3]]  # a voter that repeats another
    q, rate, rho = toxicity.label_model(v, v[:, :3].mean(1))
    assert ((q > 0.5) == y).mean() > 0.9 and rate[1, 0] > rate[1, 3] and rho[3, 4] > 0.5


def test_quality(odd, none, spark):
    labels = spark.createDataFrame([(1, 1), (9, 0), (10, 0), (None, 1), (3, None)], "doc_id long, quality int")
    out = quality.classify(odd, labels, F.col("source"), F.col("lang")).toPandas()
    assert len(out) == odd.count() and out.score.between(0, 1).all()
    assert quality.classify(none, labels.limit(0), F.col("source"), F.col("lang")).count() == 0
    # a site with few documents stays near its parent, one with many moves away
    rows = [(i, "plain words of text", "big" if i < 400 else "small") for i in range(402)]
    df = spark.createDataFrame([*rows, *[(1000 + i, "plain words of text", f"h{i % 20}") for i in range(400)]], "doc_id long, text string, source string")
    marks = spark.createDataFrame([(i, 0) for i in range(402)] + [(1000 + i, 1) for i in range(400)], "doc_id long, quality int")
    r = quality.classify(df, marks, F.col("source"), F.lit("p")).groupBy(F.col("doc_id").cast("long").alias("d")).agg(F.max("host_rate").alias("h")).toPandas().set_index("d").h
    assert r[0] < 0.1 and r[0] < r[400]


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (8, 9), (7, 7), (None, 1), (20, 9)], "src long, dst long")
    got = {r["node"]: r["component"] for r in components(edges, Scratch(spark, "t")).collect()}
    assert got == {2: 2, 3: 2, 4: 2, 5: 2, 8: 8, 9: 8, 20: 8}
    chain = spark.range(300).selectExpr("id as src", "id + 1 as dst")
    assert components(chain, Scratch(spark, "t")).where("component = 0").count() == 301
    assert components(edges.limit(0), Scratch(spark, "t")).count() == 0




def test_toxicity_weights_count_as_repeats():
    rng = np.random.RandomState(5)
    x, y = rng.rand(300, 3), rng.rand(300) < 0.3
    v, n = np.c_[x > 0.6, y], np.where(y, 1, 4)
    one, more = toxicity.label_model(v, y, weight=n), toxicity.label_model(v.repeat(n, 0), y.repeat(n))
    assert np.allclose(one[0].repeat(n), more[0]) and np.allclose(one[1], more[1]) and np.allclose(one[2], more[2])
    one, more = toxicity.logistic(x, one[0], weight=n), toxicity.logistic(x.repeat(n, 0), more[0])
    assert np.allclose(one[0], more[0]) and np.isclose(one[1], more[1])


def test_toxicity_of_a_thin_sample(spark):
    """Leaving out most clean rows of the sample leaves the classifier as it is."""
    rng = np.random.RandomState(7)
    kind = rng.choice(3, 6000, p=[0.83, 0.12, 0.05])  # plain, clean with the vague word, toxic
    bad = ["vilest", "foulest", "grossest"]
    texts = []
    for k in kind:
        words = [f"w{j}" for j in rng.randint(0, 300, 20)] + ["blargh"] * int(k > 0)
        texts.append(" ".join(words + list(rng.permutation(bad)[:2]) * int(k == 2 and rng.rand() < 0.5)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(k == 2)) for i, k in enumerate(kind)], "doc_id long, toxic int")
    whole, thin = (toxicity.fit(docs, labels, sample=n) for n in (40_000, 480))
    assert abs(whole.bias - thin.bias) < 0.5  # one class read 19 times thinner moves it by about ln 19 if nothing corrects that
    a, b = (toxicity.score(docs, m).toPandas().sort_values("doc_id") for m in (whole, thin))
    assert (a.predicted.to_numpy() == b.predicted.to_numpy()).all() and np.abs(a.score.to_numpy() - b.score.to_numpy()).max() < 0.03


def test_label_model_equals_a_plain_loop():
    """The same estimates, one row and one voter at a time."""
    rng = np.random.RandomState(11)
    y = rng.rand(60) < 0.3
    v = np.stack([np.where(rng.rand(60) < a, y, ~y) for a in (0.9, 0.8, 0.7)], 1).astype(float)
    q = v.mean(1)
    got, rate, _ = toxicity.label_model(v, q, rounds=3)
    for _ in range(3):
        prior = (q.sum() + 1) / 62
        fires = [[min(max((sum((q[i] if c else 1 - q[i]) * v[i][j] for i in range(60)) + 0.05) / (sum(q[i] if c else 1 - q[i] for i in range(60)) + 1), 1e-6), 1 - 1e-6) for j in range(3)] for c in (0, 1)]
        left = [[v[i][j] - (1 - q[i]) * fires[0][j] - q[i] * fires[1][j] for j in range(3)] for i in range(60)]
        spread = [(sum(left[i][j] ** 2 for i in range(60)) / 60) ** 0.5 + 1e-9 for j in range(3)]
        rho = [[sum(left[i][a] * left[i][b] for i in range(60)) / 60 / (spread[a] * spread[b]) for b in range(3)] for a in range(3)]
        share = [1 / (1 + sum(max(0, rho[a][b]) for b in range(3) if b != a)) for a in range(3)]
        new = []
        for i in range(60):
            z = np.log(prior / (1 - prior))
            for j in range(3):
                z += share[j] * (np.log(fires[1][j] / fires[0][j]) if v[i][j] else np.log((1 - fires[1][j]) / (1 - fires[0][j])))
            new.append(1 / (1 + np.exp(-z)))
        q = np.array(new)
    assert np.allclose(got, q) and np.allclose(rate, fires)


def test_toxicity_scores_equal_a_plain_reading(spark):
    """Strengths and scores of a fitted model, word by word."""
    rng = np.random.RandomState(2)
    vile = ["grobbly", "grobbish", "snarkest"]
    texts, marks = [], []
    for i in range(600):
        bad = i % 5 == 1
        words = [f"w{j}" for j in rng.randint(0, 200, 15)] + list(rng.choice(vile, 4) if bad else []) + (["YOU", "idiot!!"] if i % 35 == 1 else [])
        texts.append(" ".join(rng.permutation(words)))
        marks.append((i, int(bad)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))
    place = {int(c): i for i, c in enumerate(model.codes)}
    assert toxicity.term_code("grobbly") in place and toxicity.term_code("grobbly", 4) in place
    got = toxicity.score(docs, model).orderBy("doc_id").toPandas()
    for text, score in zip(texts[:80], got.score, strict=False):
        words = re.findall(r"[a-z0-9]+", text.lower())
        sums, sure, times = [0.0] * toxicity.LEXICONS, 0, Counter()
        for x in words:
            found = [place.get(toxicity.term_code(x, k)) for k in toxicity.KINDS if k < len(x)]
            found = [t for t in found if t is not None]
            times.update(found)
            one = max((t for t in found if model.voter[t] >= 0), key=lambda t: (model.worth[t], -model.voter[t]), default=None)
            if one is not None:
                sums[model.voter[one]] += model.worth[one]
                sure += model.voter[one] < toxicity._REPEATED
        for t, n in times.items():
            if model.again[t] >= 0 and n >= toxicity.AGAIN:
                sums[model.again[t]] += 1
        seeds = [x in {y for z in toxicity.SEEDS for y in z} for x in words]
        near = sum(s and any(y in toxicity.ADDRESS for y in words[max(0, i - 3) : i]) for i, s in enumerate(seeds))
        letters = [c for c in text if c.isascii() and c.isalpha()]
        pat = [min(1, text.count("!") / len(words)), sum(c.isupper() for c in letters) / len(letters), min(1, near / 2), min(1, max(0, sum(seeds) - 1) / 4), min(1, len(words) / 1000)]
        z = np.dot(np.r_[np.log1p(sums), np.log1p(sure), pat], model.weight) + model.bias
        assert np.isclose(score, 1 / (1 + np.exp(-np.clip(z, -30, 30))))
    assert (got.predicted == [m for _, m in marks]).mean() > 0.99


def test_pipeline_stages_take_odd_tables(spark, tmp_path):
    """Nulls, repeats, long and empty texts, an empty table, and columns that clash with added ones."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars int, kept_text string, n_words string, score double, copies string, mix_lang string, n_tokens string, _copy string, component_id string"
    texts = [PARA, PARA.upper(), None, "", " \t", PARA + " extra", "very long " * 20_000, "x" * 100_000, PARA]
    rows = [(i if i != 8 else None, t, "en" if i % 2 else None, None if i == 3 else "a", None if t is None else len(t), "k", "w", 0.5, "c", "m", "t", "y", "z") for i, t in enumerate(texts)]
    rows.append(rows[5])
    spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (rows, []):
        docs = spark.createDataFrame(table, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name == "bpe":
                assert (out.count() > 0) == bool(table)
                continue
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
            docs = Scratch(spark, "t").cut(out, name)
            ids = sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in docs.select("doc_id").collect())
            if table and name == "toxicity":
                assert ids == [-1, 0, 1, 2, 3, 4, 5, 5, 6, 7]
            elif table and name == "ngram_join":
                assert ids == [-1, 0, 2, 3, 4, 6, 7]
            assert bool(ids) == bool(table)
