"""What grows with the input, and what may not: rows of one group, lists of the index, copies in a task."""

from __future__ import annotations

from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from orrery.llm import components, embedding_dedup, ngram_join, slots, substring_dedup, token_store, vectors
from orrery.llm.scratch import Scratch

SENT = substring_dedup._SENT


def words(rng, n):
    return [f"u{x}" for x in rng.randint(0, 10**9, n)]


def batch(doc, text):
    return pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([doc], pa.int64()), pa.array([text])], names=["doc", "text", "body"])


def by_bucket(out):
    rows = pa.Table.from_batches(out, SENT).to_pylist()
    groups = {}
    for r in rows:
        groups.setdefault(r["bucket"], []).append(r)
    return groups


@pytest.mark.parametrize("hold", [4096, 1 << 18])
def test_a_passage_in_ten_thousand_runs_sends_few_rows(hold):
    """All grams of the passage are frequent, so inside it one of them is the minimiser wherever it stands."""
    rng = np.random.RandomState(4)
    passage = words(rng, 40)
    runs = [batch(i, " ".join(words(rng, 6) + passage + words(rng, 6))) for i in range(10_000)]
    tk = substring_dedup.tk
    grams = slots.Bits(22)
    grams.add(tk.rolling(next(tk.runs(pa.array([" ".join(passage)])))[1].hash, 5))
    frequent, everything = SimpleNamespace(value=grams.hit), SimpleNamespace(value=np.full(1 << 19, 255, np.uint8))
    marks = Counter()
    for r in pa.Table.from_batches(list(substring_dedup._announce(20, 5, frequent, 1 << 24, hold)(runs)), SENT).to_pylist():
        marks[r["bucket"]] += len(r["data"]) // substring_dedup._MARK.itemsize if r["doc"] is None else 0
    assert sum(marks.values()) > 20_000 and max(marks.values()) < 100
    strings = Counter()
    for r in pa.Table.from_batches(list(substring_dedup._send(20, 5, frequent, everything, 1 << 24, hold)(runs)), SENT).to_pylist():
        strings[r["bucket"]] += int(np.frombuffer(r["data"], "<i4", 1)[0]) if r["doc"] is None else 0
    assert sum(strings.values()) > 20_000 and max(strings.values()) < 100


@pytest.mark.parametrize(("hold", "tasks"), [(3, 4), (40, 2), (1 << 18, 1), (40, 30)])
def test_spans_do_not_depend_on_pools_and_tasks(hold, tasks):
    """Both passes by hand, over tasks that differ between them, against brute force."""
    rng = np.random.RandomState(hold % 97 + tasks)
    shared = [words(rng, 60) for _ in range(3)]
    texts = []
    for _ in range(120):
        p = shared[rng.randint(3)]
        a = rng.randint(0, 30)
        texts.append(words(rng, rng.randint(0, 20)) + p[a : a + rng.randint(15, 60)] + words(rng, rng.randint(0, 20)))
    texts += texts[:7]
    order = rng.permutation(len(texts))
    none = SimpleNamespace(value=np.zeros(1 << 19, np.uint8))
    spans = []

    def passed(step, deal):
        out = []
        for t in range(tasks):
            out += step([batch(int(i), " ".join(texts[i])) for i in order if deal(int(i)) % tasks == t])
        return by_bucket(out)

    kinds = []
    for rows in passed(substring_dedup._announce(20, 5, none, 8, hold), lambda i: i).values():
        for r in substring_dedup._compare(20)(pa.Table.from_pylist(rows, SENT)).to_pylist():
            (kinds if r["doc"] is None else spans).append(r)
    bits = slots.Bits(20)
    for r in kinds:
        bits.add(np.frombuffer(r["data"], "<u8"))
    for rows in passed(substring_dedup._send(20, 5, none, SimpleNamespace(value=bits.hit), 8, hold), lambda i: i // 5).values():
        spans += substring_dedup._sort_bucket(20)(pa.Table.from_pylist(rows, SENT)).to_pylist()
    got = {i: set() for i in range(len(texts))}
    for r in spans:
        for a, b in np.frombuffer(r["data"], "<i4").reshape(-1, 2).tolist():
            got[r["doc"]].update(range(a, b))
    seen, want = set(), {}
    for i, t in enumerate(texts):
        want[i] = set()
        for j in range(len(t) - 19):
            w = tuple(t[j : j + 20])
            want[i].update(range(j, j + 20) if w in seen else ())
            seen.add(w)
    assert got == want


def test_full_slots_leave_few_on_the_top_level(spark):
    """Three hundred hits a slot: levels count in larger units, so only what is frequent reaches the top."""
    rng = np.random.RandomState(1)
    rows, hits = [], 0
    often = np.uint64(0x9ABC << 48)
    for _ in range(20):
        p = slots.Partial(14)
        for h in (rng.randint(0, 1 << 62, 250_000).astype(np.uint64) << np.uint64(2), np.full(1000, often)):
            p.add(h)
            hits += len(h)
        rows += [(n, bytearray(d)) for n, d in p.rows()]
    partials = spark.createDataFrame(rows, slots.SCHEMA)
    every = np.arange(1 << 14, dtype=np.uint64) << np.uint64(50)
    plain, scaled = slots.table(partials, 14), slots.table(partials, 14, hits)
    assert (slots.lookup(plain, every) == slots.TOP).all()
    level = slots.lookup(scaled, every)
    assert np.flatnonzero(level == slots.TOP).tolist() == [int(often >> np.uint64(50))] and level.min() > 0


def test_lists_of_one_set_are_dropped_whatever_their_level(spark):
    """A hot token of one set, of sets that cannot reach each other, and of two that can; a cold token stays as it is."""
    hot = slots.TOP << 56
    rows = [(hot | 1, 1, 50, 60), (hot | 2, 1, 50, 60), (hot | 2, 2, 200, 240), (hot | 3, 1, 50, 60), (hot | 3, 3, 52, 60), (7, 1, 50, 60)]
    scratch = Scratch(spark, "met")
    entries = scratch.cut(spark.createDataFrame(rows, "token long, rep long, size int, reach int"), "entries")
    got = sorted((r["token"], r["rep"]) for r in ngram_join._met(entries, slots.TOP, scratch).collect())
    assert [x for x in got if x[0] != (hot | 2)] == [(7, 1), (hot | 3, 1), (hot | 3, 3)]
    assert (hot | 2, 2) in got or (hot | 2, 1) not in got


@pytest.mark.parametrize("bits", [14, 20])
def test_ngram_join_with_full_slots(spark, bits):
    """14 bits: 25 hits a slot or so. The lists keep what sets share, and the components are those of the texts."""
    rng = np.random.RandomState(3)
    rows = []
    for i in range(1500):
        base = words(rng, 260) if i % 3 else ["the", "same", "first", "words"] * 5 + words(rng, 240)
        rows.append((2 * i, " ".join(base)))
        if i % 10 == 0:
            base[rng.randint(260)] = "other"
            rows.append((2 * i + 1, " ".join(base)))
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), sketch_bits=bits).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {d: d // 2 * 2 for d, _ in rows}


def test_dealt_vectors_come_a_block_at_a_time(monkeypatch):
    """A task's batches stay as large as its input, however many blocks a cell has."""
    rng = np.random.RandomState(5)
    x = rng.randn(64, 8)
    x /= np.sqrt((x**2).sum(1))[:, None]

    class One:
        def places(self, x):
            n = len(x)
            return np.arange(n), np.zeros(n, np.int64), np.zeros(n, bool)

    monkeypatch.setattr(vectors, "usable", lambda b: [(8, np.arange(64), np.ones(64, np.int64), x)])
    out = list(embedding_dedup._deal(One(), {(8, 0, False): 50})([None]))
    sent = [sum(len(v) for v in b.column(b.num_columns - 1).to_pylist()) for b in out]
    assert len(out) == 50 and sent == [x.nbytes] * 50


def jobs(spark, group, f):
    """What ``f`` returns, and the number of Spark jobs that it takes."""
    spark.sparkContext.setJobGroup(group, group)
    out = f()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, n


def test_a_slot_table_takes_as_many_jobs_with_many_partitions(spark):
    """An iterator over the sums ran one job after the other, one for each partition."""
    partial = slots.Partial(20)
    partial.add(slots.tk.mix(np.arange(1000, dtype=np.uint64)))
    rows = spark.createDataFrame(pa.Table.from_batches(list(partial.batches())))
    bits = slots.Bits(20)
    bits.add(slots.tk.mix(np.arange(1000, dtype=np.uint64)))
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(n) for n in names]
    try:
        spark.conf.set(names[0], "24")
        spark.conf.set(names[1], "false")
        got = [jobs(spark, "levels", lambda: slots.table(rows, 20)), jobs(spark, "heavy", lambda: slots.heavy(rows, 20, 0, 0)), jobs(spark, "bits", lambda: slots.bit_table(spark.createDataFrame(pa.Table.from_batches(list(bits.batches()))), 20))]
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)
    assert all(n <= 3 for _, n in got), got
    hit = slots.lookup(got[0][0], slots.tk.mix(np.arange(1000, dtype=np.uint64)))
    assert hit.all() and np.array_equal(got[1][0], got[2][0])


def test_components_in_few_jobs(spark):
    """Against union and find: chains, stars whose middle is not the smallest, and random edges; a chain in few rounds."""
    rng = np.random.RandomState(3)
    edges = [*((i, i + 1) for i in range(0, 200)), *((1500, 1000 + i) for i in range(900)), *map(tuple, rng.randint(3000, 5000, (1600, 2)).tolist())]
    up = {n: n for e in edges for n in e}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    src = spark.createDataFrame(edges, "src long, dst long").repartition(7)
    got, n = jobs(spark, "stars", lambda: components.components(src, Scratch(spark, "t")))
    found = {r["node"]: r["component"] for r in got.collect()}
    assert found == {k: find(k) for k in found} and set(up) - set(found) == {k for k in up if all(a == b for a, b in edges if k in (a, b))}
    assert n <= 36, n


def test_stars_of_parts(monkeypatch):
    """Sorted edges in lots of four: the rows of one node are never in two lots."""
    monkeypatch.setattr(components, "_HELD", 4)
    edges = [(5, 1), (6, 2), (7, 3), (7, 4), (7, 5), (8, 1), (9, 9 - 1)]
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*edges[k : k + 2], strict=True)], names=["hi", "lo"]) for k in range(0, len(edges), 2)]
    out = [tuple(r.values()) for r in pa.Table.from_batches(list(components._stars(batches))).to_pylist()]
    assert out == [(5, 1), (6, 2), (4, 3), (5, 3), (7, 3), (8, 1), (9, 1)]
    none = np.empty(0, np.int64)
    assert [len(x) for x in components.stars(none, none)] == [0, 0]


def test_cuts_of_many_documents_equal_those_of_each():
    """Documents of all lengths cut in one pass over their ids, against a plain reading of the rule window by window."""
    rng = np.random.RandomState(9)
    docs = [rng.randint(0, top, n).astype("<u4") for n in (0, 1, 15, 16, 17, 64, 65, 66, 300, 1024, 1025, 5000, 40, 2100, 0) for top in (3, 49_000, 1 << 17)]
    docs.append(np.zeros(5000, "<u4"))

    def plain(ids):
        out, at, n = [], 0, len(ids)
        mixed = [int(v) for v in slots.tk.mix(ids.astype(np.uint64) + np.uint64(1))]
        for e in range(1, n + 1):
            h = 0
            for v in mixed[e - token_store.WINDOW : e] if e >= token_store.WINDOW else []:
                h = (h * 0x9E3779B97F4A7C15 + v) % 2**64
            meets = e >= token_store.WINDOW and int(slots.tk.mix(np.array([h], np.uint64))[0]) % token_store.AVERAGE == 0
            while (meets or e == n) and e - at > token_store.MOST and n > token_store.LEAST:
                out.append(token_store.MOST)
                at += token_store.MOST
            if meets and e - at >= token_store.LEAST and n > token_store.LEAST or e == n and e > at:
                out.append(e - at)
                at = e
        return out

    flat, edges = np.concatenate(docs), np.cumsum([0, *map(len, docs)]).tolist()
    got = token_store.cuts_of(flat, edges)
    assert got == [plain(d) for d in docs] == [token_store.cuts(d).tolist() for d in docs]
