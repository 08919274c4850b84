"""Periodic lattices in long form (``cell, v`` with cell = (i*n + j)*n + k) and their exchange with points.

Sums that must not depend on the order of rows are taken in fixed point: each term is rounded to a whole
number of ``1 / SCALE`` first, and integers are added.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.operators.cells import AXES, cell_of

SCALE = 1_000_000_000


def fixed(v: Column, scale: int = SCALE) -> Column:
    """Nearest whole number of 1/scale."""
    return F.floor(v * float(scale) + 0.5).cast("long")


def index(n: int) -> dict[str, Column]:
    c = F.col("cell")
    return {"i": F.expr(f"cell div {n * n}"), "j": F.expr(f"(cell div {n}) % {n}"), "k": c % n}


def counts(points: DataFrame, n: int) -> DataFrame:
    """``cell, n`` for every cell of the lattice, empty ones included."""
    filled = points.groupBy(cell_of(n).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    every = points.sparkSession.range(n**3).withColumnRenamed("id", "cell")
    return every.join(filled, "cell", "left").select("cell", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _corners(df: DataFrame, n: int, scale: float) -> tuple[DataFrame, dict]:
    """Index and weights of the lattice corners to the left and right of each point, per axis."""
    cols, part = {}, {}
    for a in AXES:
        p = F.col(a) * scale
        i = F.floor(p)
        cols |= {f"_{a}0": F.pmod(i, F.lit(n)), f"_{a}1": F.pmod(i + 1, F.lit(n)), f"_{a}l": (i + 1) - p}
        part[a] = (F.col(f"_{a}l"), 1 - F.col(f"_{a}l"))
    return df.withColumns(cols), part


def corners(df: DataFrame, n: int, value, scale: float | None = None) -> DataFrame:
    """Explode each point to its 8 corners: ``cell`` and ``c`` = value(weights per axis, signs)."""
    out, part = _corners(df, n, float(n) if scale is None else scale)
    items = []
    for s in product((0, 1), repeat=3):
        cell = (F.col(f"_x{s[0]}") * n + F.col(f"_y{s[1]}")) * n + F.col(f"_z{s[2]}")
        wts = [part[a][b] for a, b in zip(AXES, s, strict=True)]
        items.append(F.struct(cell.cast("long").alias("cell"), value(wts, s).alias("c")))
    out = out.withColumn("_e", F.explode(F.array(*items)))
    return out.select(*df.columns, F.col("_e.cell").alias("cell"), F.col("_e.c").alias("c"))


def deposit(points: DataFrame, n: int, weight: str | None = "w", scale: float | None = None) -> DataFrame:
    """Cloud-in-cell mass: ``cell, mass_fx`` (fixed point), filled cells only. Positions in the unit cube
    (or in lattice units with ``scale`` 1)."""
    w = F.col(weight) if weight else F.lit(1.0)
    c = corners(points, n, lambda t, s: w * t[0] * t[1] * t[2], scale)
    return c.groupBy("cell").agg(F.sum(fixed(F.col("c"))).alias("mass_fx"))


def deposit_rate(points: DataFrame, n: int, weight: str = "w", scale: float | None = None) -> DataFrame:
    """Rate of change of the cloud-in-cell mass for velocities vx, vy, vz: ``cell, rate_fx``.

    Velocities are in lattice units per time; per corner the sum over axes of sign * momentum * the
    weights of the other axes.
    """
    mom = [F.col(weight) * F.col(f"v{a}") for a in AXES]

    def value(t, s):
        terms = []
        for q in range(3):
            o = [t[p] for p in range(3) if p != q]
            terms.append((mom[q] if s[q] else -mom[q]) * o[0] * o[1])
        return terms[0] + terms[1] + terms[2]

    c = corners(points, n, value, scale)
    return c.groupBy("cell").agg(F.sum(fixed(F.col("c"))).alias("rate_fx"))


def gather(lattice: DataFrame, points: DataFrame, n: int, values: list[str], scale: float | None = None, as_fixed: bool = False) -> DataFrame:
    """Trilinear interpolation of lattice columns at points: ``id`` and the columns.

    Positions are in the unit cube (or lattice units with ``scale`` 1); any real value wraps. Missing
    cells count as 0. One join serves all columns.
    """
    c = corners(points.select("id", *AXES), n, lambda t, s: t[0] * t[1] * t[2], scale).select("id", "cell", "c")
    joined = c.join(lattice.select("cell", *values), "cell", "left")
    term = lambda v: F.coalesce(F.col(v).cast("double"), F.lit(0.0)) * F.col("c")
    return joined.groupBy("id").agg(*[(F.sum(fixed(term(v))) if as_fixed else F.sum(term(v))).alias(v) for v in values])


def gather_displacement(lattice: DataFrame, points: DataFrame, n: int, box: float, boost: DataFrame | None = None, boost_n: int = 0, repeat: int = 1) -> DataFrame:
    """Vector lattice (vx, vy, vz) at coordinates in [0, box), plus a finer lattice tiled ``repeat`` times."""
    v = ["vx", "vy", "vz"]
    out = gather(lattice, points, n, v, scale=n / box)
    if boost is None:
        return out
    fine = gather(boost, points, boost_n, v, scale=boost_n * repeat / box)
    return out.unionByName(fine).groupBy("id").agg(*[F.sum(c).alias(c) for c in v])


def shift(lattice: DataFrame, n: int, di: int, dj: int, dk: int) -> DataFrame:
    """The lattice rolled by whole cells: the value of cell c moves to c + (di, dj, dk)."""
    ix = index(n)
    to = [F.pmod(ix[a] + d, F.lit(n)) for a, d in zip("ijk", (di, dj, dk), strict=True)]
    return lattice.withColumn("cell", ((to[0] * n + to[1]) * n + to[2]).cast("long"))


def subsample(lattice: DataFrame, n: int, step: int = 2) -> DataFrame:
    """Every ``step``-th cell along each axis, renumbered for the smaller lattice."""
    m = n // step
    ix = index(n)
    keep = reduce(lambda a, b: a & b, [ix[a] % step == 0 for a in "ijk"])
    d = {a: (ix[a] / step).cast("long") for a in "ijk"}
    return lattice.where(keep).withColumn("cell", ((d["i"] * m + d["j"]) * m + d["k"]).cast("long"))


#: Twelve times the weights of the five-point first derivative.
FIVE_POINT = {2: -1, 1: 8, -1: -8, -2: 1}


def gradient12(lattice: DataFrame, n: int, value: str = "v") -> DataFrame:
    """Twelve times the periodic five-point gradient: ``cell, gx, gy, gz``; exact for integers.

    Each value is sent to the 12 cells it contributes to and summed there, so one shuffle with partial
    sums does all axes. Fewer than 3 cells per side: zeros.
    """
    ix = index(n)
    items = []
    zero = F.lit(0)
    for q, a in enumerate("ijk"):
        for o, wt in FIVE_POINT.items():
            to = {b: ix[b] for b in "ijk"} | {a: F.pmod(ix[a] - o, F.lit(n))}
            c = F.col(value) * wt if n >= 3 else zero * F.col(value)
            g = [c if p == q else zero * F.col(value) for p in range(3)]
            items.append(F.struct(((to["i"] * n + to["j"]) * n + to["k"]).cast("long").alias("cell"), *[v.alias(f"g{b}") for v, b in zip(g, AXES, strict=True)]))
    out = lattice.select(F.explode(F.array(*items)).alias("e")).select("e.*")
    return out.groupBy("cell").agg(*[F.sum(f"g{b}").alias(f"g{b}") for b in AXES])


def gradient(lattice: DataFrame, n: int, value: str = "v") -> DataFrame:
    """Periodic five-point gradient at unit spacing."""
    g = gradient12(lattice, n, value)
    return g.select("cell", *[(F.col(f"g{b}") / 12).alias(f"g{b}") for b in AXES])


def full(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n**3).withColumnRenamed("id", "cell")


def save_levels(lattice: DataFrame, n: int, path: str, least: int = 64) -> list[int]:
    """Write a lattice and its halved resolutions down to ``least``, one partition each; refuses to
    overwrite."""
    sizes, parts, m, cur = [n], [lattice.withColumn("ngrid", F.lit(n))], n, lattice
    while m % 2 == 0 and m // 2 >= least:
        cur, m = subsample(cur, m), m // 2
        sizes.append(m)
        parts.append(cur.withColumn("ngrid", F.lit(m)))
    reduce(DataFrame.unionByName, parts).write.mode("errorifexists").partitionBy("ngrid").parquet(path)
    return sizes
