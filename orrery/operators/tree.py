"""Refinement trees and particle octrees, one level at a time.

A cell is (depth, i, j, k) with i, j, k below 2**depth; ``key`` is its Morton code, three bits per level with
x highest. A level is one projection and one explode, so a tree of any size is as many passes as levels.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.cells import AXES, interval_distance
from orrery.operators.lattice import fixed
from orrery.sources.staging import cut

#: Deepest Morton code that one BIGINT holds.
DEEPEST = 20


def sphere_test(centre: tuple[float, float, float], r: float, theta: float) -> Callable[[Column], Column]:
    """Refine while the periodic distance, less ``r``, is small against the width: d2*theta2 < (w + theta*r)2."""
    th = float(np.float32(theta))

    def test(width: Column) -> Column:
        d = [interval_distance(F.col(a) * width - c, width) for a, c in zip("ijk", centre, strict=True)]
        edge = width + th * r
        return (d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) * (th * th) < edge * edge

    return test


def ellipsoid_test(matrix, centre: tuple[float, float, float], theta: float, k: float = 1.0) -> Callable[[Column], Column]:
    """As ``sphere_test`` with x.A.x - k in place of the squared distance."""
    a = np.asarray(matrix, float)
    th = float(np.float32(theta))

    def test(width: Column) -> Column:
        d = [interval_distance(F.col(c) * width - o, width) for c, o in zip("ijk", centre, strict=True)]
        q = sum((d[p] * d[s] * float(a[p, s]) for p in range(3) for s in range(3)), F.lit(0.0)) - k
        return q * (th * th) < width * width

    return test


def refine(spark: SparkSession, test: Callable[[Column], Column], max_depth: int, max_cells: int | None = None) -> DataFrame:
    """Leaves ``depth, i, j, k`` of the unit cube refined while ``test`` holds.

    A level turns each open cell that is to be refined into its eight children and closes the others: one
    explode per level in a single lineage, dealt out over all tasks at depth 3. Raises if the cells to
    refine pass ``max_cells`` nodes.
    """
    df = spark.range(1).selectExpr("0 as depth", "cast(0 as bigint) as i", "cast(0 as bigint) as j", "cast(0 as bigint) as k", "true as open")
    child = [F.struct((F.col("depth") + 1).alias("depth"), *[(F.col(c) * 2 + o).alias(c) for c, o in zip("ijk", (q >> 2, q >> 1 & 1, q & 1), strict=True)], F.lit(True).alias("open")) for q in range(8)]
    same = F.struct("depth", "i", "j", "k", F.lit(False).alias("open"))
    for depth in range(max_depth):
        df = df.withColumn("_r", F.col("open") & test(F.lit(2.0**-depth)))
        if max_cells is not None and 7 * max_cells + 1 < df.agg(F.sum(F.when(F.col("_r"), 8).otherwise(1))).first()[0]:
            raise MemoryError(f"the tree needs over {max_cells} nodes")
        df = df.select(F.explode(F.when(F.col("_r"), F.array(*child)).otherwise(F.array(same))).alias("e")).select("e.*")
        if depth == 2:
            df = df.repartition("i", "j", "k")
        if depth % 4 == 3:
            df = cut(df, "level")
    return df.drop("open")


def force_levels(leaves: DataFrame, levels: list[int]) -> DataFrame:
    """Deepen each leaf to the least allowed depth that is not below its own."""
    levels = sorted(levels)
    target = F.lit(None)
    for t in reversed(levels):
        target = F.when(F.col("depth") <= t, t).otherwise(target)
    side = F.pow(F.lit(2.0), F.col("_t") - F.col("depth")).cast("long")
    out = leaves.withColumn("_t", target).withColumn("_s", side)
    out = out.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_s") * F.col("_s") * F.col("_s") - 1)))
    return out.select(F.col("_t").cast("int").alias("depth"), (F.col("i") * F.col("_s") + F.expr("_o div (_s * _s)")).alias("i"), (F.col("j") * F.col("_s") + F.expr("(_o div _s) % _s")).alias("j"), (F.col("k") * F.col("_s") + F.col("_o") % F.col("_s")).alias("k"))


def forced_node_count(leaves: DataFrame, levels: list[int]) -> int:
    """Nodes of the tree after ``force_levels``: those of the tree, and of each leaf's own subtree."""
    n = leaves.count()
    inner = (n - 1) // 7
    target = F.lit(None)
    for t in reversed(sorted(levels)):
        target = F.when(F.col("depth") <= t, t).otherwise(target)
    extra = leaves.select(F.expr("1").alias("one"), (target - F.col("depth")).alias("d")).groupBy("d").count().collect()
    return inner + sum(r["count"] * ((8 ** r["d"] - 1) // 7) for r in extra)


def centres(leaves: DataFrame, box: float = 1.0) -> DataFrame:
    """``depth, x, y, z, size`` of leaves in a box."""
    size = F.pow(F.lit(2.0), -F.col("depth")) * box
    return leaves.select("depth", *[((F.col(c) + 0.5) * size).alias(a) for c, a in zip("ijk", AXES, strict=True)], size.alias("size"))


def zoom_levels(n: int) -> list[int]:
    """Depths allowed for a finest depth n."""
    return list(range(n + 1)) if n < 4 else [n - 4, n - 2, n - 1, n]


def zoom_uniform(spark: SparkSession, box: float, gridsize: int, test: Callable[[Column], Column]) -> DataFrame:
    """Cells of a zoomed set: finest ``gridsize`` (a power of two) where ``test`` asks for it."""
    n = gridsize.bit_length() - 1
    if 1 << n != gridsize:
        raise ValueError("the grid size must be a power of two")
    levels = zoom_levels(n)
    leaves = force_levels(refine(spark, test, n), levels)
    return centres(leaves, box).withColumn("id", F.monotonically_increasing_id())


def zoom_ellipsoid(spark: SparkSession, box: float, gridsize: int, centre: tuple[float, float, float], matrix, theta: float = 0.15) -> DataFrame:
    """``zoom_uniform`` around the ellipsoid (x - centre) A (x - centre) = 1, all in units of the box.

    The form is scaled to a largest eigenvalue of 1, so that it is at most a squared length: a cell of width w is
    refined while theta2 times its least value there (each axis by itself) is below w2.
    """
    a = np.asarray(matrix, float) * box * box
    top = float(np.linalg.eigvalsh(a)[-1])
    if not np.allclose(a, a.T) or np.linalg.eigvalsh(a)[0] <= 0:
        raise ValueError("the matrix must be symmetric and positive")
    return zoom_uniform(spark, box, gridsize, ellipsoid_test(a / top, tuple(c / box for c in centre), theta, 1 / top))


def zoom_around(points: DataFrame, gridsize: int, theta: float = 0.15, box: float = 1.0) -> DataFrame:
    """Zoom cells around the smallest ellipsoid that holds all ``points`` (in units of the box)."""
    from orrery.functions.shape import bounding_ellipsoid

    a, c = bounding_ellipsoid(points)
    return zoom_ellipsoid(points.sparkSession, box, gridsize, tuple(map(float, c)), a, theta)


def leaves_in_box(leaves: DataFrame, lower: tuple[float, float, float], upper: tuple[float, float, float], without: tuple[int, int, int, int] | None = None, max_leaves: int | None = None) -> DataFrame:
    """Leaves that meet a periodic box, less those below the node (depth, i, j, k) of ``without``."""
    w = F.pow(F.lit(2.0), -F.col("depth"))
    ok = F.lit(True)
    for c, lo, hi in zip("ijk", lower, upper, strict=True):
        a0, a1 = F.col(c) * w, (F.col(c) + 1) * w
        ok = ok & reduce(lambda x, y: x | y, [(a0 + s < hi) & (F.lit(lo) < a1 + s) for s in (-1.0, 0.0, 1.0)])
    if without:
        d, *at = without
        up = F.pow(F.lit(2.0), F.col("depth") - d).cast("long")
        inside = F.col("depth") >= d
        for c, v in zip("ijk", at, strict=True):
            inside = inside & (F.floor(F.col(c) / up) == v)
        ok = ok & ~inside
    out = leaves.where(ok)
    if max_leaves is not None and out.limit(max_leaves + 1).count() > max_leaves:
        raise MemoryError(f"over {max_leaves} leaves meet the box")
    return out


def morton(depth: int, x: str = "x", y: str = "y", z: str = "z") -> Column:
    """Morton code of a position in the unit cube at ``depth`` (at most 20)."""
    if depth > DEEPEST:
        raise ValueError(f"one code holds {DEEPEST} levels")
    out = F.lit(0).cast("long")
    cell = [F.floor(F.col(a) * float(1 << depth)).cast("long") for a in (x, y, z)]
    for b in range(depth - 1, -1, -1):
        for c in cell:
            out = out * 2 + F.shiftright(c, b).bitwiseAND(F.lit(1))
    return out


def octree(points: DataFrame, max_depth: int, bucket: int = 1, weight: str | None = "w") -> DataFrame:
    """Nodes ``depth, key, n, mass, mx, my, mz, leaf`` of the bucketed octree over points.

    A node is split while it has over ``bucket`` points and is above ``max_depth``; points that never
    separate end in one leaf there. ``mass`` and the first moments are in fixed point. All levels are
    aggregated in one shuffle, over codes shortened level by level.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    src = points.select(morton(max_depth).alias("m"), w.alias("w"), *[(w * F.col(a)).alias(f"w{a}") for a in AXES])
    depth = F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("depth")
    every = src.select("*", depth).withColumn("key", F.expr(f"shiftright(m, 3 * ({max_depth} - depth))"))
    node = every.groupBy("depth", "key").agg(F.count(F.lit(1)).alias("n"), F.sum(fixed(F.col("w"))).alias("mass"), *[F.sum(fixed(F.col(f"w{a}"))).alias(f"m{a}") for a in AXES])
    up = node.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("up"), F.col("n").alias("n_up"))
    kept = node.withColumn("up", F.shiftright("key", 3)).join(up, ["depth", "up"], "left").where((F.col("depth") == 0) | (F.col("n_up") > bucket))
    return kept.select("depth", "key", "n", "mass", "mx", "my", "mz", ((F.col("n") <= bucket) | (F.col("depth") == max_depth)).alias("leaf"))


def octree_order(points: DataFrame, depth: int = DEEPEST) -> DataFrame:
    """``id, row``: points numbered along the octree (Morton code, then id)."""
    from orrery.sources.particle_files import number_rows

    return number_rows(points.select("id", morton(depth).alias("m")), "m", "id").select("id", "row")


def leaf_counts(nodes: DataFrame, max_depth: int) -> DataFrame:
    """``depth, key, leaves`` below every node of an octree."""
    leaf = nodes.where("leaf").select("depth", "key")
    up = leaf.withColumn("d", F.explode(F.sequence(F.lit(0), F.col("depth"))))
    return up.groupBy(F.col("d").alias("depth"), F.expr("shiftright(key, 3 * (depth - d))").alias("key")).agg(F.count(F.lit(1)).alias("leaves"))


def leaves_below(nodes: DataFrame, depth: int, key: int) -> DataFrame:
    """Leaves of an octree under the node (depth, key)."""
    return nodes.where(F.col("leaf") & (F.col("depth") >= depth) & (F.expr(f"shiftright(key, 3 * (depth - {depth}))") == key))


def occupancy(nodes: DataFrame) -> DataFrame:
    """Leaves, deepest level, and least, largest and total points of leaves."""
    return nodes.where("leaf").agg(F.count(F.lit(1)).alias("leaves"), F.max("depth").alias("depth"), F.min("n").alias("least"), F.max("n").alias("most"), F.sum("n").alias("points"))


def chunks(nodes: DataFrame, most: int) -> DataFrame:
    """Cut a tree into the highest nodes with at most ``most`` points: ``depth, key, n``."""
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("up"), F.col("n").alias("n_up"))
    small = nodes.where((F.col("n") <= most) | F.col("leaf")).withColumn("up", F.shiftright("key", 3))
    return small.join(up, ["depth", "up"], "left").where(F.col("n_up").isNull() | (F.col("n_up") > most)).select("depth", "key", "n")
