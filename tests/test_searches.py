"""Kd splits, Morton ranges, nearest neighbours, lookups and shifts against plain readings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import cells, domains, graph, lookup, neighbours, tree


def points(spark, xyz, ids=None):
    rows = [(int(i), *map(float, p)) for i, p in zip(range(len(xyz)) if ids is None else ids, xyz, strict=True)]
    return spark.createDataFrame(rows, "id long, x double, y double, z double")


def image(d):
    return d - np.floor(d + 0.5)


def plain_load(k, m, growth):
    """Slab, share and load of the best cut of a line with edge slabs, both shares tried at every slab."""
    total, best = np.cumsum(k), [None, None]
    for t in range(1, len(k) - 2):
        left, right = float(total[t + 1]), float(total[-1] - total[t - 1])
        share = min(max(int(m * left / (left + right)) if left + right else 0, 1), m - 1)
        for q, a in enumerate((share, min(share + 1, m - 1))):
            v = max((1 + growth * np.log(x)) * n / x for x, n in ((a, left), (m - a, right)))
            if best[q] is None or v < best[q][0]:
                best[q] = (v, t, a)
    return best[0] if best[0] and best[0][0] < best[1][0] else best[1]


def plain_boxes(grid, m):
    n = len(grid)
    shift = []
    for a in range(3):
        k = grid.sum(tuple(x for x in range(3) if x != a))
        shift.append(int(np.argmin(k + np.roll(k, 1))))
    g = np.pad(np.roll(grid, [-s for s in shift], (0, 1, 2)), 1, mode="wrap")
    todo, done = [([0, n] * 3, m)], []
    while todo:
        b, own = todo.pop(0)
        sub = g[b[0] : b[1] + 2, b[2] : b[3] + 2, b[4] : b[5] + 2]
        found = [(plain_load(sub.sum(tuple(x for x in range(3) if x != a)), own, 1.35 * (m / n**3) ** (1 / 3)), a) for a in range(3) if own > 1 and b[2 * a + 1] - b[2 * a] > 1]
        if not found:
            done.append((b, sub.sum()))
            continue
        (_, t, share), a = min(found, key=lambda v: (v[0][0], v[1]))
        low, high = list(b), list(b)
        low[2 * a + 1] = high[2 * a] = b[2 * a] + t
        todo += [(low, share), (high, own - share)]
    out = np.zeros_like(grid)
    for d, (b, _) in enumerate(sorted(done, key=lambda x: -x[1]), 1):
        out[b[0] : b[1], b[2] : b[3], b[4] : b[5]] = d
    return np.roll(out, shift, (0, 1, 2))


@pytest.mark.parametrize(("n", "m"), [(5, 7), (4, 70)])
def test_kd_split(spark, n, m):
    rng = np.random.default_rng(n)
    xyz = np.concatenate([rng.random((150, 3)) * [0.7, 1, 1], 0.3 + 0.05 * rng.random((100, 3))])
    grid = np.zeros((n,) * 3, int)
    np.add.at(grid, tuple((xyz * n).astype(int).T), 1)
    got = domains.kd_domains(points(spark, xyz), n, m).toPandas().sort_values("cell")
    assert got["cell"].tolist() == list(range(n**3))
    assert got["domain"].tolist() == plain_boxes(grid, m).ravel().tolist()


def test_load_partition(spark):
    x = np.random.default_rng(4).random(300) ** 2
    k = np.bincount((x * 20).astype(int), minlength=20)
    load, split, left = plain_load(np.concatenate([k[-1:], k, k[:1]]), 5, 0.2)
    r = domains.load_partition(points(spark, np.stack([x, x, x], 1)), "x", 20, 5, 0.2).first()
    assert (r["split"], r["left"]) == (split, left) and abs(r["load"] - load) < 1e-9


def test_running_sums(spark):
    v = np.random.default_rng(1).integers(0, 9, (2, 50))
    df = spark.createDataFrame([(g, p, int(v[g, p])) for g in (0, 1) for p in range(50)], "g int, p long, v long")
    for width in (1, 7, 100):
        got = cells.running_sums(df, ["g"], "p", "v", width).orderBy("g", "p").toPandas()
        assert got["upto"].tolist() == np.cumsum(v, 1).ravel().tolist()


def plain_nearest(ids, xyz, k):
    d = image(xyz[:, None] - xyz[None])
    r2 = d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2]
    return [[j for _, j in sorted((r2[a, b], ids[b]) for b in range(len(ids)) if b != a)[:k]] for a in range(len(ids))]


@pytest.mark.parametrize(("k", "bucket"), [(1, 1), (5, 2), (40, 16), (500, 3)])
def test_nearest_of_crowded_points(spark, k, bucket):
    """Uniform points, a tight clump, and a place that very many points share."""
    rng = np.random.default_rng(k)
    xyz = np.concatenate([rng.random((60, 3)), 0.98 + 1e-4 * rng.random((60, 3)), np.tile([0.25, 0.5, 0.999], (60, 1))])
    ids = rng.permutation(1000)[: len(xyz)]
    got = neighbours.nearest(points(spark, xyz, ids), k, bucket=bucket).orderBy("i", "rank").toPandas().groupby("i")["j"].apply(list)
    assert {i: got[i] for i in ids} == dict(zip(ids, plain_nearest(ids, xyz, k), strict=True))


def test_nearest_of_few(spark):
    assert neighbours.nearest(points(spark, []), 3).count() == 0
    assert neighbours.nearest(points(spark, [(0.1, 0.2, 0.3)]), 3).count() == 0
    nulls = points(spark, [(0.1, 0.2, 0.3), (0.1, 0.2, 0.4)]).unionByName(spark.sql("select 9L id, cast(null as double) x, 0.1D y, 0.1D z"))
    assert [tuple(r)[:3] for r in neighbours.nearest(nulls, 3).orderBy("i").collect()] == [(0, 1, 1), (1, 1, 0)]


def test_nearest_plan_has_keys(spark):
    p = neighbours.nearest(points(spark, np.random.default_rng(2).random((50, 3))), 3)
    text = p._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_interval_join(spark):
    rng = np.random.default_rng(6)
    lo = rng.integers(0, 1000, 40)
    hi = lo + rng.integers(0, 300, 40) ** 2 // 200
    codes = rng.integers(0, 1500, 200)
    r = spark.createDataFrame([(k, int(a), int(b)) for k, (a, b) in enumerate(zip(lo, hi, strict=True))], "r int, lo long, hi long")
    c = spark.createDataFrame([(k, int(v)) for k, v in enumerate(codes)], "c int, code long")
    got = sorted((x["c"], x["r"]) for x in neighbours.interval_join(c, "code", r).collect())
    assert got == sorted((k, q) for k, v in enumerate(codes) for q in range(40) if lo[q] <= v < hi[q])
    assert neighbours.interval_join(c, "code", r.limit(0)).count() == 0


def test_chunks_and_their_edges(spark):
    rng = np.random.default_rng(8)
    xyz = np.concatenate([rng.random((150, 3)), 0.03 * rng.random((150, 3))])
    p = points(spark, xyz)
    nodes = tree.octree(p.withColumn("w", F.lit(1.0)), 5, 4)
    chunks = tree.chunks(nodes, 40)
    for reach in (0.0, 0.05, 0.3):
        got = {tuple(r) for r in neighbours.chunk_members(p, chunks, reach, 5).collect()}
        want = set()
        for r in chunks.collect():
            w = 0.5 ** r["depth"]
            at = np.array([sum((r["key"] >> 3 * b + q & 1) << b for b in range(5)) for q in (2, 1, 0)]) * w
            d = image(xyz - (at + w / 2))
            half = w / 2 + reach
            own = ((xyz >= at) & (xyz < at + w)).all(1)
            inside = ((d >= -half) & (d < half) | (half >= 0.5)).all(1)
            want |= {(r["depth"], r["key"], i, bool(own[i])) for i in np.flatnonzero(own | inside)}
        assert got == want
    lists = neighbours.box_ranges(spark.createDataFrame([(1, -0.1, 0.1, 0.4, 0.6, 0.9, 1.1)], "box int, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double"), 10)
    assert 0 < lists.count() <= 216 and lists.where("lo >= hi").count() == 0


@pytest.mark.parametrize("parts", [1, 3, 40])
@pytest.mark.parametrize("strict", [False, True])
def test_asof(spark, parts, strict):
    """Few table rows far from most points, one value that very many points have, nulls and NaN."""
    rng = np.random.default_rng(3)
    at = [*map(float, rng.integers(0, 50, 120)), *[20.0] * 100, None, float("nan"), -5.0, 100.0]
    x = [3.0, 7.0, 20.0, 49.0]
    p = spark.createDataFrame(list(enumerate(at)), "id int, at double").repartition(4)
    t = spark.createDataFrame([(v, f"t{v:.0f}") for v in x] + [(None, "none")], "x double, name string")
    got = {r["id"]: r["name"] for r in lookup.asof(p, "at", t, "x", strict=strict, parts=parts).collect()}
    want = {}
    for k, v in enumerate(at):
        below = [q for q in x if v is not None and (q < v if strict else q <= v)]
        if below:
            want[k] = f"t{below[-1]:.0f}"
    assert got == want
    assert lookup.asof(p, "at", t.limit(0), "x", parts=parts).count() == 0 and lookup.asof(p.limit(0), "at", t, "x", parts=parts).count() == 0


def test_interpolation_of_a_long_table(spark):
    rng = np.random.default_rng(5)
    x = np.sort(rng.random(3000))
    y = rng.random(3000)
    at = rng.random(2000) * 1.2 - 0.1
    t = spark.createDataFrame(list(zip(map(float, x), map(float, y), strict=True)), "x double, y double")
    got = lookup.interpolate(spark.createDataFrame([(k, float(v)) for k, v in enumerate(at)], "id int, at double"), t, "at", parts=6).toPandas().sort_values("id")
    inside = (at >= x[0]) & (at < x[-1])
    assert got["id"].tolist() == np.flatnonzero(inside).tolist() and np.allclose(got["y"], np.interp(at[inside], x, y), atol=1e-12)


@pytest.mark.parametrize("bins", [1, 8, 1000])
def test_best_shift(spark, bins):
    rng = np.random.default_rng(9)
    xyz = np.concatenate([rng.random((40, 3)) ** 3, np.tile([0.5, 0.01, 0.99], (20, 1))])
    r = 0.02
    got = {x["axis"]: (x["cover"], x["cut"]) for x in cells.best_shift(points(spark, xyz), r, bins).collect()}
    for q, a in enumerate("xyz"):
        lo, hi = (xyz[:, q] - r) % 1.0, (xyz[:, q] + r) % 1.0
        at = np.unique(np.concatenate([lo, hi]))
        stop = np.append(at[1:], at[0] + 1)
        cover = [int(((lo <= p) & (p < hi)).sum() + ((lo > hi) & ((p >= lo) | (p < hi))).sum() - ((lo > hi) & (lo <= p) & (p < hi)).sum()) for p in at]
        k = int(np.argmin(cover))
        assert got[a][0] == cover[k] and abs(got[a][1] - (at[k] + stop[k]) / 2 % 1) < 1e-12
    moved = cells.shift_optimally(points(spark, xyz), r, bins).orderBy("id").toPandas()
    for q, a in enumerate("xyz"):
        assert np.allclose(image(moved[a] - (xyz[:, q] - got[a][1])), 0, atol=1e-12) and moved[a].between(0, 1).all()
        assert ((moved[a] < r) | (moved[a] > 1 - r)).sum() == got[a][0]
    assert cells.shift_optimally(points(spark, []), r).count() == 0


@pytest.mark.parametrize("kind", ["chain", "star", "random", "none"])
def test_components(spark, kind):
    """Long chains, a centre with very many links, links given twice, both ways and to themselves."""
    rng = np.random.default_rng(11)
    n = 120
    order = rng.permutation(n)
    links = {
        "chain": [(order[k], order[k + 1]) for k in range(n - 1) if k % 50],
        "star": [(order[0], order[k]) for k in range(1, 100)] * 2,
        "random": [tuple(rng.integers(0, n, 2)) for _ in range(60)] + [(5, 5), (7, 3), (3, 7)],
        "none": [],
    }[kind]
    label = list(range(n))
    for _ in range(n):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    nodes = spark.range(n)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in links], "src long, dst long")
    got = {r["id"]: r["label"] for r in graph.components(nodes, df).collect()}
    assert got == dict(enumerate(label))


def test_chunks_meet_points_by_cells(spark):
    """No runs of ranges are built (windows over all chunks, points once for each length): a point comes once for each level of chunks."""
    rows = [(i, ((i * 7919) % 997) / 997, ((i * 104729) % 991) / 991, ((i * 611953) % 983) / 983) for i in range(400)]
    p = spark.createDataFrame(rows, "id long, x double, y double, z double")
    chunks = spark.createDataFrame([(1, k) for k in range(7)] + [(2, 56 + k) for k in range(8)], "depth int, key long")
    got = neighbours.chunk_members(p, chunks, 0.05, 6)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "_bucket" not in plan
    assert got.where("own").count() == 400 and got.count() == got.distinct().count()
    want = 0
    for d, key in chunks.collect():
        w = 0.5**d
        at = [sum(((key >> (3 * b + bit)) & 1) << b for b in range(d)) * w for bit in (2, 1, 0)]
        near = lambda v, o: -(w / 2 + 0.05) <= (v - o - w / 2 + 0.5) % 1 - 0.5 < w / 2 + 0.05  # noqa: B023, E731
        want += sum(all(near(v, o) for v, o in zip(r[1:], at, strict=True)) for r in rows)
    assert got.count() == want
