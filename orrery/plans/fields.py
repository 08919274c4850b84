"""Queries over transforms, meshes, trees, kernels and cosmology, each with SQL that computes the same from scratch.

Their values need sines, powers and long sums, which two engines round differently in the last bits, so they
are returned as whole numbers of a coarse unit. The SQL knows none of the engine's methods: transforms are plain
sums over all cells of a line, tree and mesh forces sums over all pairs or all modes, integrals Simpson's rule.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions import cosmology, kernels
from orrery.operators import fourier, gravity, lattice
from orrery.plans.catalogue import _C, _P, _corner_sql, _fx, _modes_sql, query
from orrery.sources import views

#: Box, force split and lattice of the queries.
BOX, N, SPLIT = 100.0, 16, kernels.ForceSplit("cubic", 0.15, n=16, deconvolve=True)
AXES = ("x", "y", "z")


def _whole(df: DataFrame, scale: int, *names: str, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    return df.select(*keys, *[lattice.fixed(F.col(n), scale).alias(f"{n}_fx") for n in names])


def _fxs(scale: str, **columns: str) -> str:
    return ", ".join(f"{_fx(v, f'{scale}::DOUBLE')} AS {k}_fx" for k, v in columns.items())


# --- transforms


def _dft(src: str, out: str, inverse: bool) -> str:
    """Three passes of plain sums along k, j and i of ``src`` (i, j, k, re, im)."""
    sign, share = (1, f" / {N}.0::DOUBLE") if inverse else (-1, "")
    parts = [f"{out}_w AS (SELECT p, q, cos(2*pi()*((p*q) % {N})/{N}) AS c, {sign}*sin(2*pi()*((p*q) % {N})/{N}) AS s FROM range({N}) a(p), range({N}) b(q))"]
    for axis, name in (("k", f"{out}_k"), ("j", f"{out}_j"), ("i", out)):
        others = ", ".join(a for a in "ijk" if a != axis)
        parts.append(f"{name} AS (SELECT {others}, q AS {axis}, sum(re*c - im*s){share} AS re, sum(re*s + im*c){share} AS im FROM {src} JOIN {out}_w ON p = {axis} GROUP BY {others}, q)")
        src = name
    return ", ".join(parts)


_CELLS = f"z AS (SELECT range AS cell, range // {N * N} AS i, range // {N} % {N} AS j, range % {N} AS k FROM range({N**3}))"
_MODE = _modes_sql(N)
_DK = f"(2*pi()/{BOX}::DOUBLE)"


_POWER = f"""WITH {_P}, {_corner_sql('p', N, 'w')}, d AS (SELECT cell, sum({_fx('w*u*v*t')})::DOUBLE AS m FROM e GROUP BY cell), {_CELLS},
mean AS (SELECT sum(m) / {N**3} AS mean FROM d), r AS (SELECT i, j, k, coalesce(m, 0) / mean - 1 AS re, 0.0::DOUBLE AS im FROM z LEFT JOIN d ON d.cell = z.cell, mean),
{_dft('r', 'f', True)}, {_MODE},
g AS (SELECT a*a + b*b + c*c AS n2, re, im FROM f JOIN m ON m.cell = (f.i*{N} + f.j)*{N} + f.k),
h AS (SELECT *, 1 + (n2*pow(pi()/{N}, 2))/3 + pow(n2*pow(pi()/{N}, 2), 2)/15 AS w FROM g),
b AS (SELECT greatest(0, least({N // 2 - 1}, (SELECT max(b) FROM range({N * 2}) t(b) WHERE b = 0 OR (2*b+1)*(2*b+1) <= 4*n2))) AS bin, (re*re + im*im)*w*w AS p FROM h)"""


@query(f"""{_POWER},
s AS (SELECT bin, count(*) AS n, sum(p) AS p, sum(p*p) AS p2 FROM b GROUP BY bin)
SELECT CAST(bin AS BIGINT) AS bin, n AS n_modes, {_fxs('1000000000.0', p=f'p/(n*pow({_DK}, 3))', err=f'sqrt(greatest(p2*n - p*p, 0)/(n - 1))/(n*pow({_DK}, 3))', kmid=f'(CASE WHEN bin = 0 THEN 0 ELSE (bin + 0.5)*{_DK} END + CASE WHEN bin = {N // 2 - 1} THEN {N // 2}*{_DK}*sqrt(3) ELSE (bin + 1.5)*{_DK} END)/2')} FROM s""")
def spectrum(spark, sf):
    """Power in bins of wave number, its scatter, and the bins' middles."""
    s = fourier.spectrum(fourier.density_modes(lattice.deposit(views.particles(spark, sf), N), N), N, BOX)
    dk = 2 * np.pi / BOX
    return _whole(s.withColumn("n_modes", F.round(F.col("kvol") / dk**3).cast("long")), 1_000_000_000, "p", "err", "kmid", keys=("bin", "n_modes"))


@query(f"{_POWER} SELECT CAST(bin AS BIGINT) AS bin, {_fxs('1000000000.0', mean='avg(p)')} FROM b GROUP BY bin")
def binned_power(spark, sf):
    """The mean over each bin of a function on the modes, here their power."""
    m = fourier.density_modes(lattice.deposit(views.particles(spark, sf), N), N)
    f = m.select("cell", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("f"))
    return _whole(fourier.mean_in_bins(f, N), 1_000_000_000, "mean", keys=("bin",))


# --- meshes

_CUBIC_T = "CASE WHEN {a} <= 1e-2 THEN 1 - {a}*{a}/15 ELSE -12*(sin({a})/{a} + 2*cos({a})/({a}*{a}) - 2/({a}*{a}))/({a}*{a}) END"


def _mesh_sql(weight: str) -> str:
    """Acceleration of each point of ``c`` from the modes of its mass, weighed by an expression of ``k`` (``x`` = k / n)."""
    grad = []
    for axis in "ijk":
        at = lambda o: " AND ".join(f"v.{b} = " + (f"(y.{b} + {o + N}) % {N}" if b == axis else f"y.{b}") for b in "ijk")  # noqa: B023, E731
        grad.append("(" + " + ".join(f"{w}*(SELECT re FROM v WHERE {at(o)})" for o, w in ((2, -1), (1, 8), (-1, -8), (-2, 1))) + ")/12")
    return f"""{_corner_sql('c', N, 'id, w')}, d AS (SELECT cell, sum({_fx(f'w*{N}.0::DOUBLE*u*v*t')})::DOUBLE/1e9 AS m FROM e GROUP BY cell), {_CELLS},
r AS (SELECT i, j, k, coalesce(m, 0)::DOUBLE AS re, 0.0::DOUBLE AS im FROM z LEFT JOIN d ON d.cell = z.cell), {_dft('r', 'f', False)}, {_MODE},
h AS (SELECT i, j, k, re, im, 2*pi()*sqrt(a*a + b*b + c*c) AS kk FROM f JOIN m ON m.cell = (f.i*{N} + f.j)*{N} + f.k),
wh AS (SELECT i, j, k, re, im, CASE WHEN kk = 0 THEN 0 ELSE {weight} END AS w FROM h), wg AS (SELECT i, j, k, re*w AS re, im*w AS im FROM wh), {_dft('wg', 'v', True)},
gr AS (SELECT (y.i*{N} + y.j)*{N} + y.k AS cell, {grad[0]} AS gx, {grad[1]} AS gy, {grad[2]} AS gz FROM v y),
acc AS (SELECT id, sum(gx*(u*e.v*t)) AS ax, sum(gy*(u*e.v*t)) AS ay, sum(gz*(u*e.v*t)) AS az FROM e JOIN gr ON gr.cell = e.cell GROUP BY id)"""


_KDX = f"(kk/{N}.0::DOUBLE)"
_COARSE = f"4*pi()*{N**3}*({_CUBIC_T.format(a=f'(kk*{SPLIT.rsplit}::DOUBLE)')})/(kk*kk)*(1 + {_KDX}*{_KDX}/6 + (11.0::DOUBLE/45)*pow({_KDX}/2, 4))"
_IMG = {c: f"((a.{c}-b.{c}) - floor((a.{c}-b.{c}) + 0.5::DOUBLE))" for c in AXES}


def _pairs_sql(table: str, rmax: float, npts: int, periodic: bool, name: str = "pp", fine: float = 0.0) -> str:
    """Sums over all pairs of ``c`` below ``rmax`` of a table of K at r = rmax * (1 .. npts) / npts (expression of ``r``)."""
    d = [_IMG[c] if periodic else f"(a.{c}-b.{c})" for c in AXES]
    return f"""{name}_v AS (SELECT q, {table} AS k FROM (SELECT q, {rmax}::DOUBLE*q/{npts} AS r FROM range(1, {npts + 1}) t(q))),
{name}_d AS (SELECT a.id AS i, b.w AS w, {d[0]} AS dx, {d[1]} AS dy, {d[2]} AS dz FROM c a, c b WHERE a.id <> b.id),
{name}_r AS (SELECT *, sqrt(dx*dx + dy*dy + dz*dz) * {npts} / {rmax}::DOUBLE AS f FROM {name}_d WHERE dx*dx + dy*dy + dz*dz < {rmax}::DOUBLE*{rmax}::DOUBLE AND dx*dx + dy*dy + dz*dz > {fine}::DOUBLE*{fine}::DOUBLE),
{name}_k AS (SELECT i, dx, dy, dz, w*(coalesce(l.k, 0) + (f - floor(f))*(h.k - coalesce(l.k, 0))) AS k FROM {name}_r LEFT JOIN {name}_v l ON l.q = floor(f) JOIN {name}_v h ON h.q = floor(f) + 1),
{name} AS (SELECT id, coalesce(sum(dx*k), 0) AS ax, coalesce(sum(dy*k), 0) AS ay, coalesce(sum(dz*k), 0) AS az FROM c LEFT JOIN {name}_k ON i = id GROUP BY id)"""


_SHORT = f"-1/(r*r*r) + (4*{SPLIT.rsplit}::DOUBLE - 3*r)/pow({SPLIT.rsplit}::DOUBLE, 4)"


@query(f"WITH {_C}, {_mesh_sql(_COARSE)} SELECT id, {_fxs('1000.0', ax='ax', ay='ay', az='az')} FROM acc")
def pm_force(spark, sf):
    """Long-range part of a cubic split from a mesh of 16**3."""
    return _whole(gravity.mesh_accel(views.clustered(spark, sf), SPLIT), 1000, "ax", "ay", "az")


@query(f"WITH {_C}, {_pairs_sql(_SHORT, SPLIT.rsplit, 100, True)} SELECT id, {_fxs('10.0', ax='ax', ay='ay', az='az')} FROM pp")
def pair_force(spark, sf):
    """Short-range part of a cubic split."""
    return _whole(gravity.pair_accel(views.clustered(spark, sf), SPLIT), 10, "ax", "ay", "az")


@query(f"WITH {_C}, {_pairs_sql(_SHORT, SPLIT.rsplit, 100, True)}, {_mesh_sql(_COARSE)} SELECT pp.id, {_fxs('10.0', **{f'a{c}': f'pp.a{c} + acc.a{c}' for c in AXES})} FROM pp JOIN acc ON acc.id = pp.id")
def p3m_force(spark, sf):
    """Short plus long range."""
    return _whole(gravity.total_accel(views.clustered(spark, sf), SPLIT), 10, "ax", "ay", "az")


_TRIPLES = f"tr AS (SELECT a.range AS a, b.range AS b, c.range AS c, 2*pi()*sqrt(a.range*a.range + b.range*b.range + c.range*c.range) AS kk FROM range({N // 2 + 1}) a, range({N // 2 + 1}) b, range({N // 2 + 1}) c WHERE a.range >= b.range AND b.range >= c.range AND a.range > 0)"
_FINE = f"4*pi()*{N**3}*(({_CUBIC_T.format(a='(kk*0.1::DOUBLE)')}) - ({_CUBIC_T.format(a='(kk*0.3::DOUBLE)')}))/(kk*kk)"


@query(f"WITH {_TRIPLES} SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, CAST(c AS INTEGER) AS c, {_fxs('1000000.0', coarse=_COARSE, fine=_FINE)} FROM tr")
def mesh_weights(spark, sf):
    """Factors of the long range, and of a medium range between two radii, at distinct wave vectors."""
    w, d = SPLIT.weights(), kernels.difference_weights(N, 0.3, 0.1)
    rows = [(a, b, c, float(w[a, b, c]), float(d[a, b, c])) for a in range(1, N // 2 + 1) for b in range(a + 1) for c in range(b + 1)]
    return _whole(spark.createDataFrame(rows, "a int, b int, c int, coarse double, fine double"), 1_000_000, "coarse", "fine", keys=("a", "b", "c"))


# --- trees and stencils

_NEWTON = "-1/(r*r*r)"


@query(f"WITH {_C}, {_pairs_sql(_NEWTON, 0.2, 100, False)} SELECT id, {_fxs('10.0', ax='ax', ay='ay', az='az')} FROM pp")
def tree_exact_force(spark, sf):
    """The tree walk with every node opened: all pairs inside a cutoff, not periodic."""
    return _whole(gravity.tree_sum(views.clustered(spark, sf), 0.2, kernels.newton(0.2), theta=0.0, depth=6), 10, "ax", "ay", "az")


def _log_sql() -> str:
    lo, hi, n = 0.01, 0.2, 63
    d = [f"(b.{c}-a.{c})" for c in AXES]
    r2 = "dx*dx + dy*dy + dz*dz"
    return f"""WITH {_C}, t AS (SELECT q, 1/pow({lo}::DOUBLE*exp(ln({hi}::DOUBLE/{lo}::DOUBLE)*q/{n}), 3) AS k FROM range({n + 1}) t(q)),
d AS (SELECT a.id AS i, b.w AS w, {d[0]} AS dx, {d[1]} AS dy, {d[2]} AS dz FROM c a, c b WHERE a.id <> b.id), r AS (SELECT *, ln(sqrt({r2})/{lo}::DOUBLE)*{n}/ln({hi}::DOUBLE/{lo}::DOUBLE) AS f FROM d WHERE {r2} < {hi}::DOUBLE*{hi}::DOUBLE AND {r2} > {lo}::DOUBLE*{lo}::DOUBLE),
k AS (SELECT i, dx, dy, dz, w*(l.k + (f - l.q)*(h.k - l.k)) AS k FROM r JOIN t l ON l.q = least(floor(f), {n - 1}) JOIN t h ON h.q = l.q + 1),
s AS (SELECT i, sum(dx*k) AS ax, sum(dy*k) AS ay, sum(dz*k) AS az FROM k GROUP BY i) SELECT id, {_fxs('10.0', **{f'a{c}': f'coalesce(a{c}, 0)' for c in AXES})} FROM c LEFT JOIN s ON i = id"""


@query(_log_sql())
def log_kernel_force(spark, sf):
    """A kernel tabulated evenly in log r, over all pairs between two radii."""
    r = np.exp(np.linspace(np.log(0.01), np.log(0.2), 64))
    return _whole(gravity.log_tree_sum(views.clustered(spark, sf), 0.01, 0.2, 1 / r**3, theta=0.0, depth=6), 10, "ax", "ay", "az")


def _monopole_sql(reach: int, rmax: float) -> str:
    n = max(2 * reach + 1, int(reach / rmax))
    cell = ", ".join(f"CAST(floor({c}*{n}) AS BIGINT) AS i{c}" for c in AXES)
    off = lambda c: f"((b.i{c} - a.i{c} + {n // 2 + n}) % {n} - {n // 2})"
    far = f"greatest(abs({off('x')}), abs({off('y')}), abs({off('z')}))"
    near = ", ".join(f"{_IMG[c]} AS d{c}" for c in AXES)
    r2 = "dx*dx + dy*dy + dz*dz"
    return f"""WITH {_C}, g AS (SELECT *, {cell} FROM c), m AS (SELECT ix, iy, iz, sum(w) AS w, sum(w*x)/sum(w) AS x, sum(w*y)/sum(w) AS y, sum(w*z)/sum(w) AS z FROM g GROUP BY ix, iy, iz),
d AS (SELECT a.id AS i, b.w, {near} FROM g a JOIN g b ON a.id <> b.id AND {far} <= 1 UNION ALL SELECT a.id, b.w, {near} FROM g a JOIN m b ON {far} BETWEEN 2 AND {reach}),
r AS (SELECT *, sqrt({r2})*100/{rmax}::DOUBLE AS f FROM d WHERE {r2} < {rmax}::DOUBLE*{rmax}::DOUBLE AND {r2} > 0),
v AS (SELECT q, -1/pow({rmax}::DOUBLE*q/100, 3) AS k FROM range(1, 101) t(q)), k AS (SELECT i, dx, dy, dz, w*(coalesce(l.k, 0) + (f - floor(f))*(h.k - coalesce(l.k, 0))) AS k FROM r LEFT JOIN v l ON l.q = floor(f) JOIN v h ON h.q = floor(f) + 1),
s AS (SELECT i, sum(dx*k) AS ax, sum(dy*k) AS ay, sum(dz*k) AS az FROM k GROUP BY i) SELECT id, {_fxs('10.0', **{f'a{c}': f'coalesce(a{c}, 0)' for c in AXES})} FROM c LEFT JOIN s ON i = id"""


@query(_monopole_sql(2, 0.2))
def monopole_force(spark, sf):
    """Near cells point by point, the ring of 5**3 cells around them as their centres of mass."""
    return _whole(gravity.monopole_sum(views.clustered(spark, sf), 0.2, kernels.newton(0.2), 2), 10, "ax", "ay", "az")


@query(_monopole_sql(3, 0.2))
def monopole_force_7(spark, sf):
    """The same with two rings, 7**3 cells."""
    return _whole(gravity.monopole_sum(views.clustered(spark, sf), 0.2, kernels.newton(0.2), 3), 10, "ax", "ay", "az")


# --- kernels

_RS = 0.15


def _kernels_sql() -> str:
    h = 2.8 * 0.02
    a = f"(r/{h!r}::DOUBLE)"
    soft = f"""CASE WHEN {a} < 0.5 THEN -(32.0::DOUBLE/15)*(5 - 18*pow({a},2) + 15*pow({a},3))/pow({h!r}::DOUBLE,3) WHEN {a} <= 1 THEN -(320 - 720*{a} + 576*pow({a},2) - 160*pow({a},3) - 1/pow({a},3))/(15*pow({h!r}::DOUBLE,3)) ELSE -1/(r*r*r) END"""
    b, rs = f"{_RS}::DOUBLE", f"({_RS}::DOUBLE/4.5)"
    # the error function by Simpson's rule on 400 panels
    erf = f"(SELECT 2/sqrt(pi())*sum((CASE WHEN s = 0 OR s = 400 THEN 1 WHEN s % 2 = 1 THEN 4 ELSE 2 END)*exp(-pow(r/(2*{rs})*s/400, 2)))*(r/(2*{rs}))/1200 FROM range(401) t(s))"
    long = f"(({erf}) - 1)/(r*r*r) - exp(-pow(r/(2*{rs}), 2))/(sqrt(pi())*r*r*{rs})"
    return f"""WITH n AS (SELECT CAST(q AS INTEGER) AS node, {b}*q/50 AS r FROM range(1, 51) t(q))
SELECT node, {_fxs('1000.0', cubic=f'-1/(r*r*r) + (4*{b} - 3*r)/pow({b}, 4)', quartic=f'-1/(r*r*r) + (2.5::DOUBLE*{b}*{b} - 1.5::DOUBLE*r*r)/pow({b}, 5)', erf=long, soft=soft, soft_cubic=f'({soft}) + (4*{b} - 3*r)/pow({b}, 4)', soft_erf=f'({soft}) + {long} + 1/(r*r*r)')} FROM n"""


@query(_kernels_sql())
def kernel_tables(spark, sf):
    """Short-range kernels of the three splits, plain and softened, at 50 radii."""
    names = {"cubic": ("cubic", None), "quartic": ("quartic", None), "erf": ("erf", None), "soft_cubic": ("cubic", 0.02), "soft_erf": ("erf", 0.02)}
    cols = {k: kernels.split_table(m, _RS, 50, s) for k, (m, s) in names.items()} | {"soft": kernels.softened(kernels.nodes(_RS, 50), 2.8 * 0.02)}
    rows = [(i + 1, *(float(v[i]) for v in cols.values())) for i in range(50)]
    return _whole(spark.createDataFrame(rows, "node int, " + ", ".join(f"{k} double" for k in cols)), 1000, *cols, keys=("node",))


_QUARTIC_T = "CASE WHEN a <= 1e-2 THEN 1 - 3*a*a/56 ELSE 15*((3 - a*a)*sin(a) - 3*a*cos(a))/pow(a, 5) END"


@query(f"WITH n AS (SELECT CAST(q AS INTEGER) AS node, 0.05::DOUBLE*q AS a FROM range(401) t(q)) SELECT node, {_fxs('10000000.0', cubic=f'CASE WHEN a = 0 THEN 1 ELSE {_CUBIC_T.format(a=chr(97))} END', quartic=f'CASE WHEN a = 0 THEN 1 ELSE {_QUARTIC_T} END', erf='exp(-pow(a/4.5, 2))')} FROM n")
def transfer_functions(spark, sf):
    """Fourier transfer of the long range of the three splits."""
    a = 0.05 * np.arange(401)
    t = {m: kernels.transfer(m, a) for m in ("cubic", "quartic", "erf")}
    rows = [(i, *(float(v[i]) for v in t.values())) for i in range(401)]
    return _whole(spark.createDataFrame(rows, "node int, cubic double, quartic double, erf double"), 10_000_000, *t, keys=("node",))


@query("WITH s AS (SELECT unnest([36, 48, 54, 64, 72, 96, 108, 128, 144, 162, 192, 216, 225, 243, 256, 288, 324, 384, 432, 486, 512, 576]) AS n) SELECT CAST(q AS INTEGER) AS thousandths, CAST((SELECT min(n) FROM s WHERE n >= 6 / (q / 1000.0::DOUBLE)) AS INTEGER) AS n FROM range(11, 181) t(q)")
def split_sizes(spark, sf):
    """Lattice size that each split radius asks for."""
    return spark.createDataFrame([(q, kernels.ForceSplit("cubic", q / 1000.0).size) for q in range(11, 181)], "thousandths int, n int")


# --- cosmology

_OM, _OL, _H0 = 0.28, 0.7, 70.0


def _simpson(f: str, lo: str, hi: str, n: int) -> str:
    """Integral of an expression of ``t``."""
    return f"(SELECT sum((CASE WHEN s = 0 OR s = {n} THEN 1 WHEN s % 2 = 1 THEN 4 ELSE 2 END)*({f}))*(({hi}) - ({lo}))/{3 * n} FROM (SELECT s, ({lo}) + (({hi}) - ({lo}))*s/{n} AS t FROM range({n + 1}) x(s)))"


def _cosmology_sql() -> str:
    om, ol, ok = f"{_OM}::DOUBLE", f"{_OL}::DOUBLE", f"(1 - {_OM}::DOUBLE - {_OL}::DOUBLE)"
    h = lambda a: f"sqrt({om}/pow({a},3) + {ok}/pow({a},2) + {ol})"
    # with t = u**2 the integrand is smooth at 0
    grow = lambda a: f"{h(a)}*{_simpson(f'2*t*pow(t*t/({om} + {ok}*t*t + {ol}*pow(t,6)), 1.5)', '0.0::DOUBLE', f'sqrt({a})', 2000)}"
    return f"""WITH n AS (SELECT CAST(q AS INTEGER) AS tenths, q/10.0::DOUBLE AS a FROM range(1, 11) t(q)), one AS (SELECT {grow('1.0::DOUBLE')} AS g)
SELECT tenths, {_fxs('1000000.0', hubble=f'{_H0}::DOUBLE*{h("a")}', growth=f'({grow("a")})/g', velocity=f'{_H0}::DOUBLE*{h("a")}*pow({om}/(pow(a,3)*pow({h("a")},2)), 0.6)')} FROM n, one"""


@query(_cosmology_sql())
def expansion(spark, sf):
    """Expansion rate, growth and the velocity of a unit displacement in an open universe."""
    rows = [(q, float(cosmology.hubble(q / 10, _H0, _OM, _OL)), cosmology.growth(q / 10, _OM, _OL), cosmology.velocity_factor(q / 10, _H0, _OM, _OL)) for q in range(1, 11)]
    return _whole(spark.createDataFrame(rows, "tenths int, hubble double, growth double, velocity double"), 1_000_000, "hubble", "growth", "velocity", keys=("tenths",))


_EFST = "{k}/pow(1 + pow({a}*{k} + pow({b}*{k}, 1.5) + pow({c}*{k}, 2), 1.13), 2/1.13::DOUBLE)"


def _power_sql() -> str:
    p = lambda k: _EFST.format(k=k, a="(6.4/0.21::DOUBLE)", b="(3.0/0.21::DOUBLE)", c="(1.7/0.21::DOUBLE)")
    x = "(exp(t)*r)"
    win = f"CASE WHEN {x} < 1e-2 THEN 1 - {x}*{x}/10 ELSE 3*(sin({x}) - {x}*cos({x}))/pow({x}, 3) END"
    var = lambda r: _simpson(f"4*pi()*exp(3*t)*pow({win}, 2)*{p('exp(t)')}", "ln(1e-8::DOUBLE)", f"ln(500/{r})", 40000)
    return f"""WITH n AS (SELECT CAST(q AS INTEGER) AS q, pow(2.0::DOUBLE, q) AS r FROM range(0, 6) t(q)), v AS (SELECT q, r, {var('r')} AS v FROM n), s8 AS (SELECT v FROM v WHERE q = 3)
SELECT q, {_fxs('1000000.0', p=f'1e3*({p("(1/r)")})', sigma='0.8::DOUBLE*sqrt(v.v/s8.v)')}, {_fxs('1000000000.0', variance='v.v')} FROM v, s8"""


@query(_power_sql())
def power_and_variance(spark, sf):
    """The analytic spectrum at k = 1 / r, and its variance in spheres, plain and normalised to 0.8 at r = 8."""
    p = cosmology.efstathiou()
    norm = cosmology.normalised(p, 0.8, 1.0, 0.28, 0.72)
    rows = [(q, 1e3 * float(p(1 / 2.0**q)), math.sqrt(cosmology.tophat_variance(norm, 2.0**q)), cosmology.tophat_variance(p, 2.0**q)) for q in range(6)]
    df = spark.createDataFrame(rows, "q int, p double, sigma double, variance double")
    return df.select("q", *[lattice.fixed(F.col(c), s).alias(f"{c}_fx") for c, s in (("p", 1_000_000), ("sigma", 1_000_000), ("variance", 1_000_000_000))])
