"""Searches along the octree: interval joins of Morton ranges, boxes and their edges, exact nearest neighbours."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.operators.cells import AXES, min_image
from orrery.operators.tree import DEEPEST, morton
from orrery.sources.staging import cut

#: Nodes down to this depth are at most (8**5 - 1) / 7 rows, a bound under which they may be sent to all tasks.
TOP = 4
#: Points of a task that meets them with boxes.
PART = 50_000
#: Cells along the longest side of a box, at most.
ACROSS = 4


def interval_join(codes: DataFrame, code: str, ranges: DataFrame) -> DataFrame:
    """Rows of ``codes`` and of ``ranges(lo, hi, ...)`` with lo <= code < hi, with all columns of both.

    An equi-join: a range is looked up in buckets of the least power of two that is not shorter, of which it meets two
    at most. A code comes once for each length class that occurs (63 at most, known from one small aggregation).
    Ranges may overlap; empty ones meet nothing.
    """
    size = F.length(F.bin(F.col("hi") - F.col("lo") - 1)) * F.when(F.col("hi") - F.col("lo") > 1, 1).otherwise(0)
    r = ranges.where("hi > lo").withColumn("_level", size)
    levels = [x[0] for x in r.select("_level").distinct().collect()]
    r = r.withColumn("_bucket", F.explode(F.expr("sequence(shiftright(lo, _level), shiftright(hi - 1, _level))")))
    c = codes.withColumn("_level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"))).withColumn("_bucket", F.expr(f"shiftright(`{code}`, _level)"))
    return c.join(r, ["_level", "_bucket"]).where((F.col(code) >= F.col("lo")) & (F.col(code) < F.col("hi"))).drop("_level", "_bucket")


def box_ranges(boxes: DataFrame, depth: int, across: int = ACROSS) -> DataFrame:
    """``boxes(box, x0, x1, y0, y1, z0, z1)`` as a short list of Morton ranges each: ``box, lo, hi``.

    Boxes are periodic: bounds may leave the unit cube by up to a box. Each is covered by cells of the depth at which
    its longest side measures at most ``across`` of them; cells that follow each other in Morton order are one range.
    """
    cells = box_cells(boxes, depth, across).withColumn("lo", F.expr(f"shiftleft(cell, 3 * ({depth} - level))"))
    cells = cells.select("box", "lo", F.expr(f"lo + shiftleft(1L, 3 * ({depth} - level))").alias("hi")).distinct()
    line = Window.partitionBy("box").orderBy("lo")  # a few hundred rows: the cells of one box
    run = cells.withColumn("_new", F.coalesce((F.lag("hi").over(line) != F.col("lo")).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(line))
    return run.groupBy("box", "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_run")


def box_cells(boxes: DataFrame, depth: int, across: int = ACROSS) -> DataFrame:
    """``boxes`` (as in ``box_ranges``) with ``level, cell``: once for each Morton cell of its level that covers it."""
    side = F.greatest(*(F.col(f"{a}1") - F.col(f"{a}0") for a in AXES))
    level = F.least(F.greatest(F.floor(F.log2(F.lit(float(across)) / side)), F.lit(0)), F.lit(depth)).cast("int")
    out = boxes.withColumn("level", F.when(side > 0, level).otherwise(depth)).withColumn("_n", F.expr("shiftleft(1L, level)"))
    for a in AXES:  # whole turns of the box give each cell once
        every = F.expr(f"if(({a}1 - {a}0) * _n >= _n - 1, sequence(0L, _n - 1), sequence(floor({a}0 * _n), floor({a}1 * _n)))")
        out = out.withColumn(f"_c{a}", F.explode(every)).withColumn(f"_c{a}", (F.pmod(F.col(f"_c{a}"), F.col("_n")) + 0.5) / F.col("_n"))
    code = morton(depth, *(f"_c{a}" for a in AXES))
    return out.withColumn("_m", code).withColumn("cell", F.expr(f"shiftright(_m, 3 * ({depth} - level))")).drop("_n", "_m", *(f"_c{a}" for a in AXES))


def chunk_members(points: DataFrame, chunks: DataFrame, reach: float, depth: int = DEEPEST) -> DataFrame:
    """``depth, key, id, own``: the points of each tree chunk, and those of its periodic edge.

    ``chunks(depth, key)`` are nodes of an octree over the unit cube. The edge of one holds the points outside it of
    the box that is ``reach`` larger on each side (upper bounds excluded). Points and boxes meet on the cells of few levels: a box is
    covered by cells of one level, and a point has one cell on each level that occurs.
    """
    if reach < 0:
        raise ValueError("the reach must not be negative")
    code = points.select("id", *AXES, morton(depth).alias("_code"))
    c = chunks.select("depth", "key", F.struct("depth", "key").alias("box"), F.expr("1 / shiftleft(1L, depth)").alias("w"))
    for a, bit in zip(AXES, (2, 1, 0), strict=True):  # every third bit of the key is one axis
        bits = " + ".join(f"shiftleft(shiftright(key, {3 * b + bit}) & 1, {b})" for b in range(depth))
        c = c.withColumn(f"_{a}", F.expr(f"({bits}) * w"))
    boxes = c.select("box", "w", *(F.col(f"_{a}") for a in AXES), *((F.col(f"_{a}") - reach).alias(f"{a}0") for a in AXES), *((F.col(f"_{a}") + F.col("w") + reach).alias(f"{a}1") for a in AXES))
    # by the points, not by the bytes, of which a point's many boxes and a box's many cells are no part
    parts = max(1, points.count() // PART)
    cells = box_cells(boxes.repartition(parts, "box"), depth).select("box", "w", *(f"_{a}" for a in AXES), "level", "cell")
    sides = [2.0 ** -x[0] + 2 * reach for x in chunks.select("depth").distinct().collect()]
    # both levels where a side's last bits decide
    levels = sorted({min(max(math.floor(math.log2(ACROSS / (v * e))), 0), depth) for v in sides for e in (1 - 1e-9, 1 + 1e-9)})
    at = code.withColumn("level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"))).withColumn("cell", F.expr(f"shiftright(_code, 3 * ({depth} - level))"))
    met = at.repartition(parts, "level", "cell").join(cells.hint("merge"), ["level", "cell"])
    own = F.expr(f"shiftright(_code, 3 * ({depth} - box.depth)) = box.key")
    inside = F.lit(True)
    for a in AXES:
        d = min_image(F.col(a) - (F.col(f"_{a}") + F.col("w") / 2))
        half = F.col("w") / 2 + reach
        inside = inside & ((half >= 0.5) | ((d >= -half) & (d < half)))
    return met.where(own | inside).select("box.depth", "box.key", "id", own.alias("own"))


def _gaps(near: bool) -> Column:
    """Squared least or largest periodic distance between points of the boxes a and b."""
    out = F.lit(0.0)
    for c in AXES:
        mid = F.abs(min_image((F.col(f"a{c}0") + F.col(f"a{c}1") - F.col(f"b{c}0") - F.col(f"b{c}1")) / 2))
        half = (F.col(f"a{c}1") - F.col(f"a{c}0") + F.col(f"b{c}1") - F.col(f"b{c}0")) / 2
        g = F.greatest(mid - half, F.lit(0.0)) if near else F.least(mid + half, F.lit(0.5))
        out = out + g * g
    return out


def nearest(points: DataFrame, k: int, bucket: int = 16, depth: int = DEEPEST) -> DataFrame:
    """``i, rank, j, r2``: the k nearest others of each point in the periodic unit cube, ties to the smaller id.

    Points at one place share a search, in which the k + 1 smallest ids of a place suffice. Places are the leaves of an octree
    of ``bucket`` places, with the boxes that bound them. All leaves walk the tree from its root at once, a depth each round: a
    leaf's candidates are replaced by their children, and those go whose least distance is beyond the least radius
    within which the candidates must hold k + 1 places. The pairs of leaves that remain are joined with
    their places. Every join has a key; the walk grows with leaves, not with pairs of points. With k or fewer other
    points, all are returned.
    """
    src = points.select("id", *AXES).where(" and ".join(f"{a} is not null" for a in AXES))
    place = Window.partitionBy(*AXES)
    few = src.withColumn("_t", F.row_number().over(place.orderBy("id"))).where(F.col("_t") <= k + 1)  # limited before the shuffle, too
    few = cut(few.withColumns({"place": F.min("id").over(place), "m": morton(depth)}).drop("_t"), "places")
    at = few.where("id = place").drop("id")
    every = at.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn("key", F.expr(f"shiftright(m, 3 * ({depth} - depth))"))
    node = every.groupBy("depth", "key").agg(F.count(F.lit(1)).alias("n"), *(f(a).alias(f"b{a}{e}") for a in AXES for e, f in enumerate((F.min, F.max))))
    up = node.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("up"), F.col("n").alias("n_up"))
    node = node.withColumn("up", F.shiftright("key", 3)).join(up, ["depth", "up"], "left").where((F.col("depth") == 0) | (F.col("n_up") > bucket))
    node = cut(node.withColumn("leaf", (F.col("n") <= bucket) | (F.col("depth") == depth)).drop("n_up"), "nodes")
    box = [f"{a}{e}" for a in AXES for e in (0, 1)]
    leaf = node.where("leaf").select(F.struct("depth", "key").alias("a"), *(F.col(f"b{c}").alias(f"a{c}") for c in box))
    root = node.where("depth = 0").select(F.struct("depth", "key").alias("b"), "n", "leaf", *(f"b{c}" for c in box))
    walk = leaf.join(F.broadcast(root.withColumn("_r", F.lit(0))), F.col("_r") == F.expr("a.depth * 0")).drop("_r")
    deepest = node.agg(F.max("depth")).first()[0] or 0
    far = Window.partitionBy("a").orderBy("far")
    for d in range(1, deepest + 1):
        child = node.where(F.col("depth") == d).select("up", F.struct("depth", "key").alias("b"), "n", "leaf", *(f"b{c}" for c in box))
        rest = walk.where("not leaf").select("a", *(f"a{c}" for c in box), F.col("b.key").alias("_up"))
        down = rest.join(F.broadcast(child) if d <= TOP else child, F.col("_up") == F.col("up")).drop("_up", "up")
        walk = down.unionByName(walk.where("leaf").select(*down.columns))
        walk = walk.withColumns({"near": _gaps(True), "far": _gaps(False)}).withColumn("_n", F.sum("n").over(far))
        reach = F.min(F.when(F.col("_n") > k, F.col("far"))).over(Window.partitionBy("a"))
        walk = walk.withColumn("_reach", reach).where(F.col("_reach").isNull() | (F.col("near") <= F.col("_reach") * (1 + 1e-9) + 1e-15))
        walk = cut(walk.drop("near", "far", "_n", "_reach"), "walk")
    ranges = node.where("leaf").select(F.struct("depth", "key").alias("node"), F.expr(f"shiftleft(key, 3 * ({depth} - depth))").alias("lo"), F.expr(f"shiftleft(key + 1, 3 * ({depth} - depth))").alias("hi"))
    held = cut(interval_join(few, "m", ranges).drop("lo", "hi", "m"), "held")
    q = held.where("id = place").select(F.col("node").alias("a"), F.col("place").alias("p"), *(F.col(c).alias(f"{c}i") for c in AXES))
    c = held.select(F.col("node").alias("b"), F.col("id").alias("j"), *(F.col(c).alias(f"{c}j") for c in AXES))
    pairs = walk.select("a", "b").join(q, "a").join(c, "b")
    d = [min_image(F.col(f"{a}i") - F.col(f"{a}j")) for a in AXES]
    pairs = pairs.select("p", "j", (d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("r2"))
    best = pairs.withColumn("_t", F.row_number().over(Window.partitionBy("p").orderBy("r2", "j"))).where(F.col("_t") <= k + 1).drop("_t")
    same = few.where("id = place").select("place", *(F.col(a).alias(f"_{a}") for a in AXES))
    ids = src.join(same, [F.col(a) == F.col(f"_{a}") for a in AXES]).select(F.col("id").alias("i"), F.col("place").alias("p"))
    out = ids.join(best, "p").where("i <> j").withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("r2", "j")))
    return out.where(F.col("rank") <= k).select("i", "rank", "j", "r2")
