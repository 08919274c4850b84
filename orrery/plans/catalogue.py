"""All queries of the engine by name, with the SQL that checks them where SQL can say it.

Outputs with SQL are whole numbers, or sums in fixed point of terms that need only + - * / sqrt floor, so
that two engines agree to the last bit. Queries without SQL (transforms, exponentials, loops) are tested
against NumPy.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.functions import cosmology, kernels, shape
from orrery.operators import cells, domains, fourier, graph, gravity, lattice, lookup, neighbours, tree
from orrery.plans import initial_conditions as ics
from orrery.sources import particle_files, snapshots, staging, views
from orrery.streaming import evolve

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Radii and sizes of the queries.
R, B, N_TABLE = 0.05, 0.03, 16

_P = """p AS (SELECT o_orderkey AS id, ((o_orderkey*7919 + 104729) % 1000003) / 1000003.0::DOUBLE AS x,
  ((o_custkey*15485863 + o_orderkey*31) % 999983) / 999983.0::DOUBLE AS y, ((o_orderkey*32452843 + o_custkey*17) % 999979) / 999979.0::DOUBLE AS z,
  CAST(1 + o_orderkey % 7 AS DOUBLE) AS w, (o_orderkey % 11 - 5) / 64.0::DOUBLE AS vx, (o_custkey % 13 - 6) / 64.0::DOUBLE AS vy,
  ((o_orderkey + o_custkey) % 17 - 8) / 64.0::DOUBLE AS vz FROM orders)"""
_C = """c AS (SELECT vec_id AS id, (embedding[1]::DOUBLE + 1) / 2 AS x, (embedding[2]::DOUBLE + 1) / 2 AS y, (embedding[3]::DOUBLE + 1) / 2 AS z,
  CAST(1 + vec_id % 7 AS DOUBLE) AS w FROM embeddings)"""


def _cell(n: int, t: str = "") -> str:
    q = f"{t}." if t else ""
    return f"CAST((floor({q}x*{n})*{n} + floor({q}y*{n}))*{n} + floor({q}z*{n}) AS BIGINT)"


def _fx(v: str, scale: str = "1000000000.0::DOUBLE") -> str:
    return f"CAST(floor(({v})*{scale} + 0.5::DOUBLE) AS BIGINT)"


def _img(a: str, b: str) -> str:
    return f"(({a}-{b}) - floor(({a}-{b}) + 0.5::DOUBLE))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_R2 = f"({_img('a.x', 'b.x')}*{_img('a.x', 'b.x')} + {_img('a.y', 'b.y')}*{_img('a.y', 'b.y')} + {_img('a.z', 'b.z')}*{_img('a.z', 'b.z')})"
#: Periodic pairs closer than R, all pairs tried.
_PAIRS = f"pairs AS (SELECT a.id AS i, b.id AS j, b.w AS wj, {_img('a.x', 'b.x')} AS dx, {_img('a.y', 'b.y')} AS dy, {_img('a.z', 'b.z')} AS dz, {_R2} AS r2 FROM p a, p b WHERE a.id <> b.id AND abs({_img('a.x', 'b.x')}) < {R} AND {_R2} < {R}::DOUBLE*{R}::DOUBLE)"
_EIGHT = "k8 AS (SELECT * FROM (VALUES (0,0,0),(0,0,1),(0,1,0),(0,1,1),(1,0,0),(1,0,1),(1,1,0),(1,1,1)) AS t(a, b, c))"


def _corner_sql(src: str, n: int, extra: str) -> str:
    """Corners of each row of ``src``: cell and the three weights u, v, t."""
    parts = ", ".join(f"floor({c}*{n}.0::DOUBLE) AS i{c}, (floor({c}*{n}.0::DOUBLE)+1) - {c}*{n}.0::DOUBLE AS l{c}" for c in "xyz")
    wt = [f"CASE WHEN {s}=0 THEN l{c} ELSE 1-l{c} END" for s, c in zip("abc", "xyz", strict=True)]
    cell = f"CAST(((CAST(ix AS BIGINT)+a)%{n}*{n} + (CAST(iy AS BIGINT)+b)%{n})*{n} + (CAST(iz AS BIGINT)+c)%{n} AS BIGINT)"
    return f"q AS (SELECT *, {parts} FROM {src}), {_EIGHT}, e AS (SELECT {extra}, {cell} AS cell, a, b, c, {wt[0]} AS u, {wt[1]} AS v, {wt[2]} AS t FROM q, k8)"


# --- binning and lattices


@query(f"WITH {_P}, n AS (SELECT {_cell(8)} AS cell, count(*) AS n FROM p GROUP BY 1) SELECT r.range AS cell, coalesce(n, 0) AS n FROM range(512) r LEFT JOIN n ON n.cell = r.range")
def cell_counts(spark, sf):
    return lattice.counts(views.particles(spark, sf), 8)


@query(f"WITH {_P}, n AS (SELECT {_cell(8)} AS cell, count(*) AS k FROM p GROUP BY 1) SELECT cell, CAST(sum(k) OVER (ORDER BY cell) - k AS BIGINT) AS start, CAST(sum(k) OVER (ORDER BY cell) AS BIGINT) AS stop FROM n")
def cell_runs(spark, sf):
    return cells.cell_runs(views.particles(spark, sf), 8)


@query(f"WITH {_P}, {_corner_sql('p', 16, 'w')} SELECT cell, CAST(sum({_fx('w*u*v*t')}) AS BIGINT) AS mass_fx FROM e GROUP BY cell")
def cic_mass(spark, sf):
    return lattice.deposit(views.particles(spark, sf), 16)


@query(f"WITH {_P}, {_corner_sql('p', 16, 'w, vx, vy, vz')} SELECT cell, CAST(sum({_fx('(CASE WHEN a=1 THEN w*vx ELSE -(w*vx) END)*v*t + (CASE WHEN b=1 THEN w*vy ELSE -(w*vy) END)*u*t + (CASE WHEN c=1 THEN w*vz ELSE -(w*vz) END)*u*v')}) AS BIGINT) AS rate_fx FROM e GROUP BY cell")
def cic_rate(spark, sf):
    return lattice.deposit_rate(views.particles(spark, sf), 16)


_LAT8 = f"{_P}, n AS (SELECT {_cell(8)} AS cell, count(*) AS n FROM p GROUP BY 1), g AS (SELECT r.range AS cell, coalesce(n, 0) AS v FROM range(512) r LEFT JOIN n ON n.cell = r.range)"


def _lat8(spark, sf):
    return lattice.counts(views.particles(spark, sf), 8).withColumnRenamed("n", "v")


@query(f"WITH {_LAT8}, {_C}, {_corner_sql('c', 8, 'id').replace(' c.', ' c.')} SELECT id, CAST(sum({_fx('CAST(g.v AS DOUBLE)*(u*e.v*t)')}) AS BIGINT) AS v FROM e JOIN g ON g.cell = e.cell GROUP BY id")
def trilinear_gather(spark, sf):
    return lattice.gather(_lat8(spark, sf), views.clustered(spark, sf), 8, ["v"], as_fixed=True)


_IJK = "cell // 64 AS i, cell // 8 % 8 AS j, cell % 8 AS k"


def _grad_sql() -> str:
    def d(a):
        terms = []
        for o, w in ((2, -1), (1, 8), (-1, -8), (-2, 1)):
            ix = [f"(g.{c} + {o} + 8) % 8" if c == a else f"g.{c}" for c in "ijk"]
            terms.append(f"{w} * (SELECT v FROM h WHERE h.i = {ix[0]} AND h.j = {ix[1]} AND h.k = {ix[2]})")
        return f"CAST({' + '.join(terms)} AS BIGINT)"

    return f"WITH {_LAT8}, h AS (SELECT v, cell, {_IJK} FROM g) SELECT g.cell, {d('i')} AS gx, {d('j')} AS gy, {d('k')} AS gz FROM h g"


@query(_grad_sql())
def lattice_gradient(spark, sf):
    return lattice.gradient12(_lat8(spark, sf), 8)


@query(f"WITH {_LAT8}, h AS (SELECT v, {_IJK} FROM g) SELECT CAST((((i+1)%8)*8 + (j+6)%8)*8 + (k+3)%8 AS BIGINT) AS cell, v FROM h")
def lattice_roll(spark, sf):
    return lattice.shift(_lat8(spark, sf), 8, 1, -2, 3)


@query(f"WITH {_LAT8}, h AS (SELECT v, {_IJK} FROM g) SELECT CAST(((i//2)*4 + j//2)*4 + k//2 AS BIGINT) AS cell, v FROM h WHERE i%2=0 AND j%2=0 AND k%2=0")
def lattice_subsample(spark, sf):
    return lattice.subsample(_lat8(spark, sf), 8)


@query(f"WITH {_P} SELECT {_cell(8)} AS cell, count(*) AS n, CAST(sum({_fx('w')}) AS BIGINT) AS mass_fx, CAST(sum({_fx('w*x')}) AS BIGINT) AS mx_fx, CAST(sum({_fx('w*y')}) AS BIGINT) AS my_fx, CAST(sum({_fx('w*z')}) AS BIGINT) AS mz_fx FROM p GROUP BY 1")
def cell_monopole(spark, sf):
    return gravity.cell_moments(views.particles(spark, sf), 8)


# --- radius joins


@query(f"WITH {_P}, {_PAIRS} SELECT count(*) // 2 AS n_pairs FROM pairs")
def pair_count(spark, sf):
    return cells.count_pairs(views.particles(spark, sf), R)


@query(f"WITH {_P}, {_PAIRS}, k AS (SELECT i, count(*) AS n FROM pairs GROUP BY i) SELECT id, coalesce(n, 0) AS n FROM p LEFT JOIN k ON i = id")
def neighbour_count(spark, sf):
    return cells.neighbour_counts(views.particles(spark, sf), R)


@query(f"WITH {_C}, d AS (SELECT a.id AS i, b.id AS j, {_R2} AS r2 FROM c a, c b WHERE a.id <> b.id) SELECT i, rank, j FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY r2, j)::INTEGER AS rank FROM d) WHERE rank <= 3")
def nearest_neighbours(spark, sf):
    return neighbours.nearest(views.clustered(spark, sf), 3).select("i", "rank", "j")


@query(f"WITH {_C}, d AS (SELECT a.id AS i, b.id AS j, {_R2} AS r2 FROM c a, c b WHERE a.id <> b.id) SELECT i, rank, j, {_fx('r2')} AS r2_fx FROM (SELECT i, j, r2, row_number() OVER (PARTITION BY i ORDER BY r2, j)::INTEGER AS rank FROM d) WHERE rank <= 40")
def nearest_forty(spark, sf):
    """As many neighbours as a smoothing kernel takes, of points that crowd in few places."""
    return neighbours.nearest(views.clustered(spark, sf), 40).select("i", "rank", "j", lattice.fixed(F.col("r2")).alias("r2_fx"))


@query(f"WITH {_C}, l AS (SELECT a.id AS i, b.id AS j, {_img('b.x', 'a.x')} AS dx, {_img('b.y', 'a.y')} AS dy, {_img('b.z', 'a.z')} AS dz, {_R2} AS r2 FROM c a, c b WHERE a.id <> b.id) SELECT i, j, {_fx('dx')} AS dx_fx, {_fx('dy')} AS dy_fx, {_fx('dz')} AS dz_fx FROM l WHERE r2 < 0.02::DOUBLE*0.02::DOUBLE")
def neighbour_vectors(spark, sf):
    c = views.clustered(spark, sf)
    v = cells.neighbour_vectors(c, cells.radius_join(c, c, 0.02, same=True))
    return v.select("i", "j", *[lattice.fixed(F.col(f"d{a}")).alias(f"d{a}_fx") for a in "xyz"])


_TABLE = f"list_transform(range(1, {N_TABLE + 1}), lambda q: -1.0::DOUBLE / ((({R}::DOUBLE * q) / {N_TABLE}) * (({R}::DOUBLE * q) / {N_TABLE}) * (({R}::DOUBLE * q) / {N_TABLE})))"


@query(f"""WITH {_P}, {_PAIRS}, t AS (SELECT {_TABLE} AS t),
f AS (SELECT *, sqrt(r2) * {N_TABLE} / {R}::DOUBLE AS f FROM pairs), g AS (SELECT *, least(CAST(floor(f) AS INTEGER), {N_TABLE - 1}) AS b FROM f),
h AS (SELECT *, CASE WHEN b = 0 THEN 0.0::DOUBLE ELSE t[b] END AS lo, t[b + 1] AS hi FROM g, t), k AS (SELECT *, wj * (lo + (f - b) * (hi - lo)) AS k FROM h),
s AS (SELECT i, sum({_fx('dx*k', '1000000.0::DOUBLE')}) AS fx, sum({_fx('dy*k', '1000000.0::DOUBLE')}) AS fy, sum({_fx('dz*k', '1000000.0::DOUBLE')}) AS fz FROM k GROUP BY i)
SELECT id, CAST(coalesce(fx, 0) AS BIGINT) AS fx, CAST(coalesce(fy, 0) AS BIGINT) AS fy, CAST(coalesce(fz, 0) AS BIGINT) AS fz FROM p LEFT JOIN s ON i = id""")
def kernel_sum(spark, sf):
    table = kernels.newton(R, N_TABLE)
    return gravity.kernel_sum(views.particles(spark, sf), R, table, N_TABLE, scale=1_000_000)


@query(f"WITH {_P}, s AS (SELECT * FROM (VALUES (0), (1), (-1)) AS t(s)), g AS (SELECT id, a.s AS sx, b.s AS sy, c.s AS sz FROM p, s a, s b, s c WHERE (a.s = 0 OR (a.s = 1 AND x < 0.1) OR (a.s = -1 AND x >= 0.9::DOUBLE)) AND (b.s = 0 OR (b.s = 1 AND y < 0.1) OR (b.s = -1 AND y >= 0.9::DOUBLE)) AND (c.s = 0 OR (c.s = 1 AND z < 0.1) OR (c.s = -1 AND z >= 0.9::DOUBLE))) SELECT * FROM g WHERE sx <> 0 OR sy <> 0 OR sz <> 0")
def ghost_pad(spark, sf):
    return cells.pad_periodic(views.particles(spark, sf), 0.1).select("id", "sx", "sy", "sz")


_Q = [f"abs({_img(a, c)})" for a, c in (("x", "0.4::DOUBLE"), ("y", "0.3::DOUBLE"), ("z", "0.2::DOUBLE"))]
_OVER = " + ".join(f"greatest({q} - 0.15::DOUBLE, 0.0::DOUBLE)*greatest({q} - 0.15::DOUBLE, 0.0::DOUBLE)" for q in _Q)


@query(f"WITH {_P} SELECT id, greatest({', '.join(_Q)}) < 0.15::DOUBLE AS inside, {_OVER} < 0.1::DOUBLE*0.1::DOUBLE AS inside_ghost, greatest({', '.join(_Q)}) > 0.15::DOUBLE - 0.1::DOUBLE AS outside_ghost, greatest({', '.join(_Q)}) >= 0.15::DOUBLE AS outside FROM p")
def subcube_ghosts(spark, sf):
    return cells.subcube_flags(views.particles(spark, sf), (0.4, 0.3, 0.2), 0.15, 0.1)


@query(f"WITH {_P}, n AS (SELECT floor(x*8) AS a, floor(y*8) AS b, floor(z*8) AS c, count(*) AS k FROM p GROUP BY ALL), o AS (SELECT range - 2 AS o FROM range(5)) SELECT id, CAST(sum(k) - 1 AS BIGINT) AS n FROM p, o i, o j, o l JOIN n ON n.a = (floor(x*8) + i.o + 8) % 8 AND n.b = (floor(y*8) + j.o + 8) % 8 AND n.c = (floor(z*8) + l.o + 8) % 8 GROUP BY id")
def stencil_neighbours(spark, sf):
    return gravity.stencil_pairs(views.particles(spark, sf), 8)


def _shift_sql() -> str:
    parts = " UNION ALL ".join(f"SELECT '{a}' AS axis, {a} - 0.0001::DOUBLE AS lo, {a} + 0.0001::DOUBLE AS hi FROM p" for a in "xyz")
    return f"""WITH {_P}, s AS ({parts}), u AS (SELECT axis, lo - floor(lo) AS lo, hi - floor(hi) AS hi FROM s),
e AS (SELECT axis, lo AS q, 1 AS d FROM u UNION ALL SELECT axis, hi, -1 FROM u), a AS (SELECT axis, q, sum(d) AS d FROM e GROUP BY ALL),
o AS (SELECT axis, count(*) FILTER (lo > hi) AS o FROM u GROUP BY axis),
w AS (SELECT a.axis, q, o.o + sum(d) OVER (PARTITION BY a.axis ORDER BY q) AS cover, lead(q) OVER (PARTITION BY a.axis ORDER BY q) AS nx, min(q) OVER (PARTITION BY a.axis) AS f FROM a JOIN o ON o.axis = a.axis),
r AS (SELECT *, coalesce(nx, f + 1) AS stop, row_number() OVER (PARTITION BY axis ORDER BY cover, q) AS k FROM w)
SELECT axis, CAST(cover AS BIGINT) AS cover, {_fx('(q+stop)/2 - floor((q+stop)/2)')} AS cut_fx FROM r WHERE k = 1"""


@query(_shift_sql())
def optimal_shift(spark, sf):
    return cells.best_shift(views.particles(spark, sf), 0.0001).select("axis", F.col("cover").cast("long").alias("cover"), lattice.fixed(F.col("cut")).alias("cut_fx"))


def _shifted_sql() -> str:
    head, _, _ = _shift_sql().rpartition("SELECT axis, ")
    moved = ", ".join(_fx(f"({a} + (1 - {a}c)) - floor({a} + (1 - {a}c))") + f" AS {a}_fx" for a in "xyz")
    best = ", ".join(f"max((q+stop)/2 - floor((q+stop)/2)) FILTER (axis = '{a}') AS {a}c" for a in "xyz")
    return f"{head}SELECT id, {moved} FROM p, (SELECT {best} FROM r WHERE k = 1)"


@query(_shifted_sql())
def shifted_points(spark, sf):
    """Points moved so that padding at the faces repeats the fewest."""
    return cells.shift_optimally(views.particles(spark, sf), 0.0001).select("id", *[lattice.fixed(F.col(a)).alias(f"{a}_fx") for a in "xyz"])


# --- groups

_FOF = f"l AS (SELECT a.id AS s, b.id AS d FROM c a, c b WHERE a.id <> b.id AND {_R2} < {B}::DOUBLE*{B}::DOUBLE), r AS (SELECT id AS s, id AS d FROM c UNION SELECT r.s, l.d FROM r JOIN l ON l.s = r.d), g AS (SELECT s AS id, min(d) AS grp FROM r GROUP BY s)"


def _groups(spark, sf):
    return graph.friends_of_friends(views.clustered(spark, sf), B)


@query(f"WITH RECURSIVE {_C}, {_FOF} SELECT id, grp FROM g")
def fof_groups(spark, sf):
    return _groups(spark, sf)


@query(f"WITH RECURSIVE {_C}, {_FOF} SELECT grp, count(*) AS n FROM g GROUP BY grp ORDER BY n DESC, grp LIMIT 10")
def fof_catalogue(spark, sf):
    return graph.catalogue(_groups(spark, sf), 10)


@query(f"WITH RECURSIVE {_C}, {_FOF}, k AS (SELECT grp, count(*) AS n FROM g GROUP BY grp) SELECT id, CASE WHEN n >= 5 THEN g.grp ELSE -1 END AS grp FROM g JOIN k ON k.grp = g.grp")
def min_size_filter(spark, sf):
    return graph.mark_small(_groups(spark, sf), 5)


@query(f"WITH {_C} SELECT DISTINCT a.id AS src, b.id AS dst FROM c a, c b WHERE a.id < b.id AND {_R2} < {B}::DOUBLE*{B}::DOUBLE")
def fof_links(spark, sf):
    c = views.clustered(spark, sf)
    return graph.links(c, B)


@query(f"""WITH RECURSIVE {_C}, d AS (SELECT {_cell(16)} AS id, count(*) AS n FROM c GROUP BY 1 HAVING count(*) > 2), h AS (SELECT *, id // 256 AS i, id // 16 % 16 AS j, id % 16 AS k FROM d),
l AS (SELECT a.id AS s, b.id AS d FROM h a, h b WHERE abs(a.i-b.i) + abs(a.j-b.j) + abs(a.k-b.k) = 1), r AS (SELECT id AS s, id AS d FROM h UNION SELECT r.s, l.d FROM r JOIN l ON l.s = r.d),
g AS (SELECT s AS id, min(d) AS label FROM r GROUP BY s)
SELECT label, count(*) AS cells, CAST(sum(n) AS BIGINT) AS n, min(i) AS i_min, max(i) AS i_max, min(j) AS j_min, max(j) AS j_max, min(k) AS k_min, max(k) AS k_max,
min(i)+max(i)+1 AS i_centre2, min(j)+max(j)+1 AS j_centre2, min(k)+max(k)+1 AS k_centre2, greatest(max(i)-min(i)+1, max(j)-min(j)+1, max(k)-min(k)+1) AS width FROM g JOIN h ON h.id = g.id GROUP BY label""")
def halo_cells(spark, sf):
    return graph.halo_cells(views.clustered(spark, sf), 16, 2)


# --- domains

_NEAR = """o AS (SELECT range - 1 AS o FROM range(3)), nb AS (SELECT id, floor(x*8) AS a, floor(y*8) AS b, floor(z*8) AS c, i.o AS oi, j.o AS oj, k.o AS ok,
  CASE i.o WHEN 1 THEN (floor(x*8)+1)/8 - x WHEN -1 THEN x - floor(x*8)/8 ELSE 0.0::DOUBLE END AS gx, CASE j.o WHEN 1 THEN (floor(y*8)+1)/8 - y WHEN -1 THEN y - floor(y*8)/8 ELSE 0.0::DOUBLE END AS gy,
  CASE k.o WHEN 1 THEN (floor(z*8)+1)/8 - z WHEN -1 THEN z - floor(z*8)/8 ELSE 0.0::DOUBLE END AS gz FROM p, o i, o j, o k),
nc AS (SELECT id, CAST((((a+oi+8)%8)*8 + (b+oj+8)%8)*8 + (c+ok+8)%8 AS BIGINT) AS cell, CAST((a*8+b)*8+c AS BIGINT) AS home FROM nb WHERE gx*gx+gy*gy+gz*gz <= (0.02::DOUBLE*1.001::DOUBLE)*(0.02::DOUBLE*1.001::DOUBLE)*(1+1e-9::DOUBLE))"""


@query(f"WITH {_P}, {_NEAR} SELECT id, bit_or(CAST(1 AS BIGINT) << CAST(cell % 60 AS INTEGER)) AS mask FROM nc GROUP BY id")
def domain_masks(spark, sf):
    masks = lattice.full(spark, 8).select("cell", F.expr("shiftleft(cast(1 as bigint), cast(cell % 60 as int))").alias("bits"))
    return domains.ghost_masks(views.particles(spark, sf), masks, 8, 0.02)


@query(f"WITH {_P}, {_NEAR}, d AS (SELECT id, cell // 64 AS domain, max(CASE WHEN cell = home THEN 1 ELSE 0 END) AS own FROM nc GROUP BY ALL) SELECT domain, CAST(sum(own) AS BIGINT) AS real, count(*) AS total FROM d GROUP BY domain")
def ghost_stats(spark, sf):
    slabs = lattice.full(spark, 8).select("cell", F.expr("cell div 64").alias("domain"))
    return domains.ghost_stats(domains.ghost_rows(views.particles(spark, sf), slabs, 8, 0.02))


def _bisect_sql() -> str:
    parts = " UNION ALL ".join(f"SELECT '{a}' AS axis, CAST(floor({a}*16) AS BIGINT) AS slab FROM c" for a in "xyz")
    return f"""WITH {_C}, s AS ({parts}), k AS (SELECT axis, slab, count(*) AS k FROM s GROUP BY ALL), r AS (SELECT axis, slab, sum(k) OVER (PARTITION BY axis ORDER BY slab) AS b, sum(k) OVER (PARTITION BY axis) AS n FROM k),
q AS (SELECT *, row_number() OVER (PARTITION BY axis ORDER BY abs(n - 2*b), slab) AS t FROM r WHERE slab < 15) SELECT axis, slab + 1 AS split, CAST(b AS BIGINT) AS below, CAST(n - b AS BIGINT) AS above FROM q WHERE t = 1"""


@query(_bisect_sql())
def kd_bisect_axis(spark, sf):
    return domains.bisect(views.clustered(spark, sf), 16)


# --- trees


def _side_sql(c: str, o: float) -> str:
    x0, x1 = f"({c}*w - {o}::DOUBLE)", f"({c}*w - {o}::DOUBLE + w)"
    return f"(CASE WHEN {x0} < 0 AND {x1} > 0 THEN 0.0::DOUBLE WHEN {x0} < 0 THEN CASE WHEN {x0} + 1 < -{x1} THEN {x0} + 1 ELSE {x1} END ELSE CASE WHEN {x1} - 1 > -{x0} THEN {x1} - 1 ELSE {x0} END END)"


_CEN = (0.5, 0.4, 0.402)
_TH = float(np.float32(0.9))
_D2 = " + ".join(f"{_side_sql(c, o)}*{_side_sql(c, o)}" for c, o in zip("ijk", _CEN, strict=True))
_REFINE = f"""t AS (SELECT 0 AS depth, 0::BIGINT AS i, 0::BIGINT AS j, 0::BIGINT AS k, 1.0::DOUBLE AS w, true AS r
UNION ALL SELECT depth + 1, i, j, k, w, depth + 1 < 7 AND ({_D2}) * ({_TH!r}::DOUBLE*{_TH!r}::DOUBLE) < (w + {_TH!r}::DOUBLE*0.02::DOUBLE)*(w + {_TH!r}::DOUBLE*0.02::DOUBLE)
FROM (SELECT depth, i*2 + o//4 AS i, j*2 + o//2%2 AS j, k*2 + o%2 AS k, w/2 AS w FROM t, range(8) AS q(o) WHERE r))"""


@query(f"WITH RECURSIVE {_REFINE}, l AS (SELECT depth, CASE WHEN depth <= 3 THEN 3 WHEN depth <= 5 THEN 5 WHEN depth <= 6 THEN 6 ELSE 7 END AS d FROM t WHERE NOT r) SELECT d AS depth, CAST(sum(CAST(pow(8, d - depth) AS BIGINT)) AS BIGINT) AS n FROM l GROUP BY d")
def refine_leaves(spark, sf):
    """The refinement tree of a small sphere, deepened to the levels 3, 5, 6, 7."""
    leaves = tree.force_levels(tree.refine(spark, tree.sphere_test(_CEN, 0.02, 0.9), 7), [3, 5, 6, 7])
    return leaves.groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


def _morton_sql(depth: int) -> str:
    bits = " + ".join(f"((CAST(floor({c}*{1 << depth}.0::DOUBLE) AS BIGINT) >> {b}) & 1) * {1 << (3 * b + q)}" for b in range(depth) for c, q in zip("xyz", (2, 1, 0), strict=True))
    return f"CAST({bits} AS BIGINT)"


_OCT = f"""m AS (SELECT {_morton_sql(6)} AS m, w, x, y, z FROM p), n AS (SELECT d.range::INTEGER AS depth, m >> CAST(3*(6-d.range) AS INTEGER) AS key, count(*) AS n, CAST(sum({_fx('w')}) AS BIGINT) AS mass, CAST(sum({_fx('w*x')}) AS BIGINT) AS mx, CAST(sum({_fx('w*y')}) AS BIGINT) AS my, CAST(sum({_fx('w*z')}) AS BIGINT) AS mz FROM m, range(7) d GROUP BY ALL),
t AS (SELECT n.*, n.n <= 11 OR n.depth = 6 AS leaf FROM n LEFT JOIN n u ON u.depth = n.depth - 1 AND u.key = n.key >> 3 WHERE n.depth = 0 OR u.n > 11)"""


def _octree(spark, sf):
    return tree.octree(views.particles(spark, sf), 6, 11)


@query(f"WITH {_P}, {_OCT} SELECT * FROM t")
def octree_nodes(spark, sf):
    return _octree(spark, sf)


@query(f"WITH {_P}, {_OCT} SELECT u.depth, u.key, count(*) AS leaves FROM t l JOIN t u ON u.depth <= l.depth AND l.key >> CAST(3*(l.depth-u.depth) AS INTEGER) = u.key WHERE l.leaf GROUP BY u.depth, u.key")
def octree_leaf_counts(spark, sf):
    return tree.leaf_counts(_octree(spark, sf), 6)


@query(f"WITH {_P}, {_OCT} SELECT depth, key, n FROM t WHERE leaf AND depth >= 2 AND key >> CAST(3*(depth-2) AS INTEGER) = 21")
def octree_branch(spark, sf):
    """Leaves under one node of the octree."""
    return tree.leaves_below(_octree(spark, sf), 2, 21).select("depth", "key", "n")


@query(f"WITH {_P}, {_OCT} SELECT count(*) AS leaves, max(depth) AS depth, min(n) AS least, max(n) AS most, CAST(sum(n) AS BIGINT) AS points FROM t WHERE leaf")
def octree_occupancy(spark, sf):
    return tree.occupancy(_octree(spark, sf))


@query(f"WITH {_P}, {_OCT} SELECT t.depth, t.key, t.n FROM t LEFT JOIN t u ON u.depth = t.depth - 1 AND u.key = t.key >> 3 WHERE (t.n <= 100 OR t.leaf) AND (u.n IS NULL OR u.n > 100)")
def octree_chunks(spark, sf):
    return tree.chunks(_octree(spark, sf), 100)


def _chunk_sql(reach: float) -> str:
    at = {a: "(" + " + ".join(f"((key >> {3 * b + q}) & 1) * {1 << b}" for b in range(6)) + f") / CAST(1 << depth AS DOUBLE)" for a, q in zip("xyz", (2, 1, 0), strict=True)}
    half = f"(w / 2 + {reach}::DOUBLE)"
    d = {a: f"(({a} - ({a}0 + w / 2)) - floor(({a} - ({a}0 + w / 2)) + 0.5::DOUBLE))" for a in "xyz"}
    inside = " AND ".join(f"({half} >= 0.5 OR ({d[a]} >= -{half} AND {d[a]} < {half}))" for a in "xyz")
    return f"""WITH {_P}, {_OCT}, h AS (SELECT t.depth, t.key FROM t LEFT JOIN t u ON u.depth = t.depth - 1 AND u.key = t.key >> 3 WHERE (t.n <= 100 OR t.leaf) AND (u.n IS NULL OR u.n > 100)),
b AS (SELECT depth, key, 1 / CAST(1 << depth AS DOUBLE) AS w, {", ".join(f"{v} AS {a}0" for a, v in at.items())} FROM h), q AS (SELECT id, x, y, z, {_morton_sql(6)} AS m FROM p)
SELECT depth, key, id, m >> CAST(3*(6-depth) AS INTEGER) = key AS own FROM b, q WHERE m >> CAST(3*(6-depth) AS INTEGER) = key OR ({inside})"""


@query(_chunk_sql(0.02))
def chunk_members(spark, sf):
    """Tree chunks of up to 100 points with their points, and those within 0.02 around them."""
    return neighbours.chunk_members(views.particles(spark, sf), tree.chunks(_octree(spark, sf), 100), 0.02, 6)


@query(f"WITH {_P}, m AS (SELECT id, {_morton_sql(12)} AS m FROM p) SELECT id, row_number() OVER (ORDER BY m, id) - 1 AS row FROM m")
def octree_order(spark, sf):
    return tree.octree_order(views.particles(spark, sf), 12)


@query(f"WITH RECURSIVE {_REFINE}, l AS (SELECT depth, i, j, k, w FROM t WHERE NOT r), s AS (SELECT * FROM (VALUES (-1.0::DOUBLE), (0.0::DOUBLE), (1.0::DOUBLE)) AS t(s)) SELECT depth, i, j, k FROM l WHERE "
       + " AND ".join(f"EXISTS (SELECT 1 FROM s WHERE {c}*w + s < {hi}::DOUBLE AND {lo}::DOUBLE < ({c}+1)*w + s)" for c, lo, hi in (("i", -0.1, 0.3), ("j", 0.3, 0.5), ("k", 0.35, 0.45)))
       + " AND NOT (depth >= 3 AND i // CAST(pow(2, greatest(depth-3, 0)) AS BIGINT) = 1 AND j // CAST(pow(2, greatest(depth-3, 0)) AS BIGINT) = 3 AND k // CAST(pow(2, greatest(depth-3, 0)) AS BIGINT) = 3)")
def leaves_in_box(spark, sf):
    """Leaves that meet a periodic box, without those below one node."""
    leaves = tree.refine(spark, tree.sphere_test(_CEN, 0.02, 0.9), 7)
    return tree.leaves_in_box(leaves, (-0.1, 0.3, 0.35), (0.3, 0.5, 0.45), (3, 1, 3, 3))


# --- wave numbers and tables

_SGN = [f"CASE WHEN {e} <= {{h}} THEN {e} ELSE {e} - {{n}} END" for e in ("r.range // ({n}*{n})", "r.range // {n} % {n}", "r.range % {n}")]


def _modes_sql(n: int) -> str:
    a, b, c = (s.format(n=n, h=n // 2) for s in _SGN)
    return f"m AS (SELECT r.range AS cell, {a} AS a, {b} AS b, {c} AS c FROM range({n**3}) r)"


@query(f"WITH {_modes_sql(32)}, q AS (SELECT greatest(0, least(15, (SELECT max(b) FROM range(32) t(b) WHERE b = 0 OR (2*b+1)*(2*b+1) <= 4*(m.a*m.a+m.b*m.b+m.c*m.c)))) AS bin FROM m) SELECT CAST(bin AS BIGINT) AS bin, count(*) AS n_modes FROM q GROUP BY 1")
def kbin_counts(spark, sf):
    return fourier.bin_counts(spark, 32)


@query(f"WITH {_modes_sql(16)}, s AS (SELECT list_reverse_sort([abs(a), abs(b), abs(c)]) AS s FROM m) SELECT s[1] AS u, s[2] AS v, s[3] AS w, count(*) AS cells FROM s GROUP BY ALL")
def k_wedge(spark, sf):
    return fourier.wedge(spark, 16)


@query("WITH e AS (SELECT event_id, value FROM events), k AS (SELECT quantity AS x0, lead(quantity) OVER (ORDER BY quantity) AS x1, n AS y0, lead(n) OVER (ORDER BY quantity) AS y1 FROM (SELECT CAST(l_quantity AS DOUBLE) AS quantity, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1)) SELECT event_id, CAST(floor((y0 + (value - x0) / (x1 - x0) * (y1 - y0)) * 1000000.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS v_fx FROM e JOIN k ON value >= x0 AND value < x1")
def table_interpolation(spark, sf):
    """Linear interpolation in a table (rows per quantity) at the values of events: lead() makes intervals."""
    t = views.table(spark, sf, "lineitem").groupBy(F.col("l_quantity").cast("double").alias("x0")).agg(F.count(F.lit(1)).cast("double").alias("y0"))
    e = views.table(spark, sf, "events").select("event_id", "value")
    v = lookup.interpolate(e, t.selectExpr("x0 as x", "y0 as y"), "value")
    return v.select("event_id", lattice.fixed(F.col("y"), 1_000_000).alias("v_fx"))


# --- steps, sizes, files


@query("WITH e AS (SELECT user_id, value, CASE event_type WHEN 'purchase' THEN 1 ELSE 2 END AS o, event_type FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, o, event_type) AS k FROM e) SELECT user_id, value AS dt, event_type AS why FROM r WHERE k = 1")
def step_limiter(spark, sf):
    """The least of many limits with its name; ties go to the first in order."""
    return evolve.least_limits(views.table(spark, sf, "events"), "user_id", "value", "event_type", ["purchase"])


def _kdk_sql() -> str:
    acc = {c: f"(0.5::DOUBLE - {c})" for c in "xyz"}
    pos = ", ".join(f"{_fx(f'(({c} + (v{c} + {acc[c]}*0.125::DOUBLE)*0.25::DOUBLE) - floor({c} + (v{c} + {acc[c]}*0.125::DOUBLE)*0.25::DOUBLE))')} AS {c}_fx" for c in "xyz")
    vel = ", ".join(f"{_fx(f'v{c} + {acc[c]}*0.25::DOUBLE')} AS v{c}_fx" for c in "xyz")
    return f"WITH {_P} SELECT id, {pos}, {vel} FROM p"


@query(_kdk_sql())
def kdk_step(spark, sf):
    """One kick-drift-kick step in a harmonic field around the centre."""
    p = views.particles(spark, sf)
    acc = p.select("id", *[(0.5 - F.col(c)).alias(f"a{c}") for c in "xyz"])
    s = evolve.kick_drift(p, acc, 0.25)
    return s.select("id", *[lattice.fixed(F.col(c)).alias(f"{c}_fx") for c in ("x", "y", "z", "vx", "vy", "vz")])


@query(f"WITH RECURSIVE {_REFINE}, l AS (SELECT depth, CASE WHEN depth <= 3 THEN 3 WHEN depth <= 5 THEN 5 WHEN depth <= 6 THEN 6 ELSE 7 END AS d FROM t WHERE NOT r) SELECT {_fx('50.0::DOUBLE / pow(2, d)')} AS size_fx, CAST(sum(CAST(pow(8, d - depth) AS BIGINT)) AS BIGINT) AS n FROM l GROUP BY d")
def size_classes(spark, sf):
    cells_ = tree.zoom_uniform(spark, 50.0, 128, tree.sphere_test(_CEN, 0.02, 0.9))
    return ics.size_classes(cells_).select(lattice.fixed(F.col("size")).alias("size_fx"), "n")


def _ellipsoid_sql(n: int, theta: float) -> str:
    th = float(np.float32(theta))
    mean = ", ".join(f"sum({_fx(a)}) / (count(*) * 1000000000.0::DOUBLE) AS c{a}, sum({_fx(f'{a}*{a}')}) / (count(*) * 1000000000.0::DOUBLE) AS s{a}" for a in "xyz")
    form = ", ".join(f"1 / (9 * (s{a} - c{a} * c{a})) AS a{a}" for a in "xyz")

    def side(c, o):
        x0, x1 = f"({c}*w - {o})", f"({c}*w - {o} + w)"
        return f"CASE WHEN {x0} < 0 AND {x1} > 0 THEN 0.0::DOUBLE WHEN {x0} < 0 THEN CASE WHEN {x0} + 1 < -{x1} THEN {x0} + 1 ELSE {x1} END ELSE CASE WHEN {x1} - 1 > -{x0} THEN {x1} - 1 ELSE {x0} END END"

    q = " + ".join(f"power({side(c, f'c{a}')}, 2) * (a{a} / top)" for c, a in zip("ijk", "xyz", strict=True))
    levels = [n - 4, n - 2, n - 1, n]
    to = "CASE " + " ".join(f"WHEN depth <= {v} THEN {v}" for v in levels) + " END"
    return f"""WITH RECURSIVE {_C}, m AS (SELECT *, {form} FROM (SELECT {mean} FROM c)), f AS (SELECT *, greatest(ax, ay, az) AS top FROM m),
t AS (SELECT 0 AS depth, 0::BIGINT AS i, 0::BIGINT AS j, 0::BIGINT AS k, 1.0::DOUBLE AS w, true AS r
UNION ALL SELECT depth + 1, i, j, k, w, depth + 1 < {n} AND ({q} - 1 / top) * ({th!r}::DOUBLE*{th!r}::DOUBLE) < w * w
FROM (SELECT depth, i*2 + o//4 AS i, j*2 + o//2%2 AS j, k*2 + o%2 AS k, w/2 AS w FROM t, range(8) AS q(o) WHERE r), f),
l AS (SELECT depth, {to} AS d FROM t WHERE NOT r) SELECT {_fx("1.0::DOUBLE / pow(2, d)")} AS size_fx, CAST(sum(CAST(pow(8, d - depth) AS BIGINT)) AS BIGINT) AS n FROM l GROUP BY d"""


@query(_ellipsoid_sql(6, 0.6))
def ellipsoid_zoom(spark, sf):
    """Zoom cells by size around the ellipsoid of three deviations of the points along the axes."""
    c = views.clustered(spark, sf)
    sums = [F.sum(lattice.fixed(F.col(a))).alias(f"c{a}") for a in "xyz"] + [F.sum(lattice.fixed(F.col(a) * F.col(a))).alias(f"s{a}") for a in "xyz"]
    r = c.agg(F.count(F.lit(1)).alias("n"), *sums).first()
    mean, square = ([r[f"{p}{a}"] / (r["n"] * 1e9) for a in "xyz"] for p in "cs")
    form = np.diag([1 / (9 * (s - m * m)) for m, s in zip(mean, square, strict=True)])
    return ics.size_classes(tree.zoom_ellipsoid(spark, 1.0, 64, tuple(mean), form, 0.6)).select(lattice.fixed(F.col("size")).alias("size_fx"), "n")


@query("""WITH o AS (SELECT o_orderkey AS id, CAST(1 + o_orderkey % 3 AS INTEGER) AS ptype FROM orders), r AS (SELECT ptype, row_number() OVER (PARTITION BY ptype ORDER BY id) - 1 AS r, count(*) OVER (PARTITION BY ptype) AS n FROM o)
SELECT CAST(r // (n // 4 + 1) AS INTEGER) AS file, ptype, count(*) AS n FROM r GROUP BY ALL""")
def split_files(spark, sf):
    """Rows per file and type when each type goes to four files."""
    p = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (1 + F.col("o_orderkey") % 3).cast("int").alias("ptype"))
    rows = particle_files.number_rows(p, "ptype", "id")
    f = particle_files.file_of(rows, 4)
    return f.groupBy("file", "ptype").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_P}, o AS (SELECT *, CAST(1 + id % 3 AS INTEGER) AS ptype FROM p)
SELECT row_number() OVER (ORDER BY ptype, id) AS id, ptype, {_fx("x * 1000.0::DOUBLE", "1000.0::DOUBLE")} AS x_fx, {_fx("z * 1000.0::DOUBLE", "1000.0::DOUBLE")} AS z_fx, {_fx("vy", "1000.0::DOUBLE")} AS vy_fx,
  CAST(CASE WHEN ptype = 2 THEN 5 ELSE w END AS BIGINT) AS mass FROM o""")
def snapshot_round_trip(spark, sf):
    """Particles written as a snapshot of three labelled files, and read back in ranges of 1,000 particles."""
    path = f"{staging.base(spark)}/snapshots/{uuid.uuid4().hex}"
    p = views.particles(spark, sf).selectExpr("id", "cast(1 + id % 3 as int) as ptype", "x", "y", "z", "vx", "vy", "vz", "w * 1e10 as mass")
    snapshots.write_gadget(p, path, 0.5, 1.0, 0.3, 0.7, files=3, double=True, masses=[0, 0, 5e10, 0, 0, 0], labels=True)
    got = snapshots.read_gadget(spark, path, ["id", "ptype", "x", "z", "vy", "mass"], rows=1000)
    return got.select("id", "ptype", *[lattice.fixed(F.col(c), 1000).alias(f"{c}_fx") for c in ("x", "z", "vy")], F.round("mass").cast("long").alias("mass"))


@query("SELECT r.range AS id, {} AS x_fx, {} AS y_fx, {} AS z_fx FROM range(512) r".format(*[_fx(f"({e}) * 0.125::DOUBLE") for e in ("r.range // 64", "r.range // 8 % 8", "r.range % 8")]))
def uniform_lattice(spark, sf):
    return views.lattice_points(spark, 8).select("id", *[lattice.fixed(F.col(c)).alias(f"{c}_fx") for c in "xyz"])


@query(f"WITH {_C}, q AS (SELECT CAST(range AS INTEGER) AS q FROM range(8)) SELECT id*8 + q AS id, {_fx('(x + q//4)*0.5::DOUBLE')} AS x_fx, {_fx('(y + q//2%2)*0.5::DOUBLE')} AS y_fx, {_fx('(z + q%2)*0.5::DOUBLE')} AS z_fx FROM c, q")
def tiled_set(spark, sf):
    return views.tile(views.clustered(spark, sf), 2).select("id", *[lattice.fixed(F.col(c)).alias(f"{c}_fx") for c in "xyz"])


@query(f"WITH {_C}, {_P}, t AS (SELECT max(id) + 1 AS t FROM c) SELECT id, {_fx('x')} AS x_fx FROM c WHERE (x-0.5)*(x-0.5) + (y-0.5)*(y-0.5) + (z-0.5)*(z-0.5) >= 0.2::DOUBLE*0.2::DOUBLE UNION ALL SELECT id + t, {_fx('x')} FROM p, t WHERE (x-0.5)*(x-0.5) + (y-0.5)*(y-0.5) + (z-0.5)*(z-0.5) < 0.2::DOUBLE*0.2::DOUBLE")
def sphere_swap(spark, sf):
    c, p = views.clustered(spark, sf).select("id", "x", "y", "z"), views.particles(spark, sf).select("id", "x", "y", "z")
    return views.replace_in_sphere(c, p, (0.5, 0.5, 0.5), 0.2).select("id", lattice.fixed(F.col("x")).alias("x_fx"))


# --- without SQL


@query()
def region_growth(spark, sf):
    c = views.clustered(spark, sf)
    w, target = domains.square_weights(c, 8, 6)
    return domains.grow_regions(w, 8, target)


@query()
def balanced_ghosts(spark, sf):
    return domains.ghost_stats(domains.balanced_domains(views.clustered(spark, sf), 0.02, 8, 8))


def _load_sql(name: str, lines: str, by: str) -> str:
    """``name(by, split, mleft, load)`` from ``lines(by, place, upto, m, growth)``: candidates cut by cut, best first."""
    side = lambda pts, k: f"(1 + growth * ln({k})) * {pts} / {k}"
    load = lambda k: f"greatest({side('l', k)}, {side('r', f'(m - {k})')})"
    return f"""{name}_c AS (SELECT *, greatest(1, least(m - 1, CASE WHEN l + r > 0 THEN CAST(floor(m * l / (l + r)) AS INTEGER) ELSE 0 END)) AS m0 FROM (
  SELECT *, CAST(lead(upto) OVER w AS DOUBLE) AS l, CAST(max(upto) OVER v - lag(upto) OVER w AS DOUBLE) AS r, max(place) OVER v AS last FROM {lines} WINDOW w AS (PARTITION BY {by} ORDER BY place), v AS (PARTITION BY {by}))
  WHERE m > 1 AND place BETWEEN 1 AND last - 2),
{name}_d AS (SELECT {by}, place, least(m0 + o, m - 1) AS k, o, l, r, m, growth FROM {name}_c, (SELECT unnest([0, 1]) AS o)),
{name}_e AS (SELECT {by}, o, place AS split, k AS mleft, {load("k")} AS load FROM {name}_d),
{name} AS MATERIALIZED (SELECT * EXCLUDE (o, t) FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY load, o DESC, split) AS t FROM {name}_e) WHERE t = 1)"""


def _kd_sql(n: int, m: int) -> str:
    shift = ", ".join(f"(SELECT p FROM (SELECT p, k + coalesce(lag(k) OVER (ORDER BY p), last_value(k) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS c FROM (SELECT {v} AS p, sum(n) AS k FROM g GROUP BY 1)) ORDER BY c, p LIMIT 1) AS s{a}" for a, v in zip("ijk", (f"cell // {n * n}", f"cell // {n} % {n}", f"cell % {n}"), strict=True))
    pads = "h AS (SELECT (cell // {nn} - si + {n}) % {n} AS i, (cell // {n} % {n} - sj + {n}) % {n} AS j, (cell % {n} - sk + {n}) % {n} AS k, n FROM g, s)".format(nn=n * n, n=n)
    for a in "ijk":
        src = {"i": "h", "j": "h_i", "k": "h_j"}[a]
        rest = ", ".join(x for x in "ijk" if x != a)
        pads += f", h_{a} AS MATERIALIZED (SELECT {rest}, n, unnest([{a} + 1] || CASE WHEN {a} = 0 THEN [{n + 1}] WHEN {a} = {n - 1} THEN [0] ELSE [] END) AS {a} FROM {src})"
    parts = [f"b0 AS (SELECT '' AS path, 0 AS i0, {n} AS i1, 0 AS j0, {n} AS j1, 0 AS k0, {n} AS k1, {m} AS m)"]
    for r in range(m):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT b.*, n, i, j, k FROM b{r} b JOIN h_k ON i BETWEEN i0 AND i1 + 1 AND j BETWEEN j0 AND j1 + 1 AND k BETWEEN k0 AND k1 + 1),
t{r} AS (SELECT path, sum(n) AS total FROM a{r} GROUP BY 1),
u{r} AS (SELECT path, axis, m, place, sum(sum(n)) OVER (PARTITION BY path, axis ORDER BY place) AS upto, {1.35 * (m / n**3) ** (1 / 3)!r}::DOUBLE AS growth FROM (
  SELECT path, m, n, unnest(['i', 'j', 'k']) AS axis, unnest([i - i0, j - j0, k - k0]) AS place FROM a{r}) GROUP BY path, axis, m, place),
{_load_sql(f"l{r}", f"u{r}", "path, axis")},
c{r} AS MATERIALIZED (SELECT b.*, t.total, l.axis, l.split, l.mleft FROM b{r} b JOIN t{r} t ON t.path = b.path LEFT JOIN (SELECT * FROM l{r} QUALIFY row_number() OVER (PARTITION BY path ORDER BY load, axis) = 1) l ON l.path = b.path),
b{r + 1} AS (""" + " UNION ALL ".join(f"SELECT path || '{q}' AS path, " + ", ".join(f"CASE WHEN axis = '{a}' THEN {a}0 + split ELSE {a}{e} END AS {a}{e}" if e == 1 - q else f"{a}{e}" for a in "ijk" for e in (0, 1)) + f", {'m - mleft' if q else 'mleft'} AS m FROM c{r} WHERE axis IS NOT NULL" for q in (0, 1)) + ")")  # fmt: skip
    ready = " UNION ALL ".join(f"SELECT path, i0, i1, j0, j1, k0, k1, total FROM c{r} WHERE axis IS NULL" for r in range(m))
    cell = f"((i + si) % {n} * {n} + (j + sj) % {n}) * {n} + (k + sk) % {n}"
    return f"""WITH {_C}, n AS (SELECT {_cell(n)} AS cell, count(*) AS k FROM c GROUP BY 1), g AS MATERIALIZED (SELECT r.range AS cell, coalesce(k, 0) AS n FROM range({n**3}) r LEFT JOIN n ON n.cell = r.range),
s AS MATERIALIZED (SELECT {shift}), {pads}, {", ".join(parts)}, d AS (SELECT *, row_number() OVER (ORDER BY total DESC, length(path), path)::INTEGER AS domain FROM ({ready})),
x AS (SELECT range AS v FROM range({n}))
SELECT CAST({cell} AS BIGINT) AS cell, domain FROM d, s JOIN (SELECT v AS i FROM x) ON i >= i0 AND i < i1 JOIN (SELECT v AS j FROM x) ON j >= j0 AND j < j1 JOIN (SELECT v AS k FROM x) ON k >= k0 AND k < k1"""


@query(_kd_sql(8, 6))
def kd_domains(spark, sf):
    return domains.kd_domains(views.clustered(spark, sf), 8, 6)


@query(f"""WITH {_P}, f AS (SELECT CAST(floor(x * 64) AS BIGINT) AS b, count(*) AS k FROM p GROUP BY 1), q AS (SELECT r.range AS place, coalesce(k, 0) AS k FROM range(66) r LEFT JOIN f ON b = (r.range + 63) % 64),
u AS (SELECT 0 AS line, place, sum(k) OVER (ORDER BY place) AS upto, 5 AS m, 0.125::DOUBLE AS growth FROM q), {_load_sql("z", "u", "line")} SELECT CAST(split AS BIGINT) AS split, CAST(mleft AS INTEGER) AS \"left\", {_fx("load", "1000.0::DOUBLE")} AS load_fx FROM z""".replace("\\", ""))
def load_partition(spark, sf):
    out = domains.load_partition(views.particles(spark, sf), "x", 64, 5, 0.125)
    return out.select("split", "left", lattice.fixed(F.col("load"), 1000).alias("load_fx"))


@query()
def displacement_field(spark, sf):
    return fourier.displacement(spark, cosmology.efstathiou(), 16, 100.0, 123)


@query()
def displacement_boost(spark, sf):
    return fourier.boost(spark, cosmology.efstathiou(), 16, 100.0, 2, 16, 124)


_SPLIT = kernels.ForceSplit("cubic", 0.15, n=16)


def _close(got, want, most: float):
    """``id, close``: whether a row's force differs from the exact one by at most ``most`` of the root mean square of all (0 if none acts)."""
    w = staging.cut(want.select("id", *[F.col(f"a{a}").alias(f"w{a}") for a in "xyz"]), "want")  # read twice
    square = lambda p, q="": reduce(add, [(F.col(f"{p}{a}") - (F.col(f"{q}{a}") if q else 0)) * (F.col(f"{p}{a}") - (F.col(f"{q}{a}") if q else 0)) for a in "xyz"])
    rms = float(w.agg(F.sqrt(F.avg(square("w")))).first()[0] or 0.0)
    return got.join(w, "id").select("id", (F.sqrt(square("a", "w")) <= most * rms).alias("close"))


@query(f"WITH {_C} SELECT id, true AS close FROM c")
def bh_force(spark, sf):
    """Tree forces with far nodes taken whole: that each is within 5 % of the exact sum."""
    c = staging.cut(views.clustered(spark, sf), "points")
    exact = gravity.kernel_sum(c, 0.2, kernels.newton(0.2), periodic=False)
    return _close(gravity.tree_sum(c, 0.2, kernels.newton(0.2), theta=0.5, depth=6), exact, 0.05)


@query(f"WITH {_C}, l AS (SELECT a.id AS i, {_R2} AS r2 FROM c a, c b WHERE a.id <> b.id), k AS (SELECT i, count(*) AS n FROM l WHERE r2 < 0.02::DOUBLE*0.02::DOUBLE GROUP BY i) SELECT id, coalesce(n, 0) AS n FROM c LEFT JOIN k ON i = id")
def domain_neighbours(spark, sf):
    """The same counts as a single pass, but domain by domain with ghosts."""
    c = views.clustered(spark, sf)
    rows = domains.balanced_domains(c, 0.02, 8, 8)
    p = c.join(rows, "id").select("id", "x", "y", "z", "domain", "own")
    n = cells.radius_join(p.where("own"), p, 0.02, same=True, by=["domain"]).groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    return c.select("id").join(n, F.col("id") == F.col("i"), "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {_C} SELECT id, greatest(abs({_img('x', '0.5')}), abs({_img('y', '0.5')}), abs({_img('z', '0.5')})) < 0.04::DOUBLE + 0.08::DOUBLE AS inside, true AS close FROM c")
def medium_range(spark, sf):
    """Three ranges of force around a cube: the zone of each point, and that its force is within 2 % of two ranges'."""
    c = staging.cut(views.clustered(spark, sf), "points")
    m = gravity.MediumRange((0.5, 0.5, 0.5), 0.04, 0.08, n=48)
    split = kernels.ForceSplit("cubic", 0.08)
    coarse = staging.cut(gravity.mesh_accel(c, split), "coarse")
    got = _close(m.accel(c, 400, coarse=coarse), gravity.added(gravity.pair_accel(c, split, 400, exact=True), coarse), 0.02)
    return got.join(m.zones(c).select("id", "inside"), "id").select("id", "inside", "close")


@query()
def evolve_box(spark, sf):
    c = views.clustered(spark, sf)
    s = c.select("*", *[F.lit(0.0).alias(f"v{a}") for a in "xyz"]).withColumn("w", F.col("w") * 1e-6)
    m = evolve.GravityModel(s, _SPLIT, 0.005)
    return list(evolve.integrate(m, [0.05], most=0.05))[-1][1]


@query()
def ellipsoid(spark, sf):
    a, c = shape.bounding_ellipsoid(views.clustered(spark, sf))
    return spark.createDataFrame([(i, *map(float, a[i]), float(c[i])) for i in range(3)], "row int, a0 double, a1 double, a2 double, centre double")


@query()
def initial_conditions(spark, sf):
    """Spectrum to displaced particles on a 16**3 lattice."""
    disp = fourier.displacement(spark, cosmology.normalised(cosmology.efstathiou(), 0.8, 0.02, 0.28, 0.72), 16, 100.0, 5)
    return ics.mass_field(views.lattice_points(spark, 16, 100.0), disp, 16, 100.0, 0.02, 100.0, 0.28, 0.72)


@query()
def measured_spectrum(spark, sf):
    return ics.measure(initial_conditions(spark, sf), 16, 100.0)


@query()
def glass_points(spark, sf):
    return evolve.glass(views.clustered(spark, sf), 12, 3)
