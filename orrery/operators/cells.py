"""Cell binning, periodic geometry and the radius join that most other operators are made of.

A radius join is an equi-join: one side is copied to the cells around each of its points, and meets the
other side on the cell number; the exact distance is the residual. It is sort-merged, so that candidates are
spread over all tasks and Spark can split hot cells at run time.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

AXES = ("x", "y", "z")


def cell_of(n: int, x: str = "x", y: str = "y", z: str = "z") -> Column:
    """Cell number (i*n + j)*n + k of a position in the unit cube."""
    i, j, k = (F.floor(F.col(a) * n) for a in (x, y, z))
    return ((i * n + j) * n + k).cast("long")


def check_unit(df: DataFrame) -> None:
    """Raise unless all positions are in [0, 1)."""
    bad = df.where(reduce(or_, [(F.col(a) < 0) | (F.col(a) >= 1) for a in AXES])).limit(1).count()
    if bad:
        raise ValueError("positions must be in [0, 1)")


def wrap(c: Column, length: float = 1.0) -> Column:
    """Position in [0, length)."""
    return c - F.floor(c) if length == 1.0 else F.pmod(c, F.lit(length))


def min_image(d: Column, length: float = 1.0) -> Column:
    """Displacement to the nearest periodic image."""
    return d - F.floor(d + 0.5) if length == 1.0 else F.pmod(d + length / 2, F.lit(length)) - length / 2


def interval_distance(x0: Column, width: Column) -> Column:
    """Signed periodic distance from 0 to the interval [x0, x0 + width] of the unit circle; 0 inside."""
    x1 = x0 + width
    below = F.when(x0 + 1 < -x1, x0 + 1).otherwise(x1)
    above = F.when(x1 - 1 > -x0, x1 - 1).otherwise(x0)
    return F.when((x0 < 0) & (x1 > 0), 0.0).when(x0 < 0, below).otherwise(above)


def neighbour_cells(df: DataFrame, n: int, r: float, reach: int = 1) -> DataFrame:
    """Copy each point to the cells within ``r`` of it (of those at most ``reach`` away), as ``cell``.

    Offsets that wrap onto the same cell (n < 2*reach + 1) give it once.
    """
    if n < 2 * reach + 1:
        every = sorted({o % n for o in range(-reach, reach + 1)})
        offsets = [(o, False) for o in every]
    else:
        offsets = [(o, True) for o in range(-reach, reach + 1)]
    out = df.withColumn("_g", F.lit(0.0))
    most = r * r * (1 + 1e-9)
    for a in AXES:  # one small explode per axis, pruned as it goes
        i = F.floor(F.col(a) * n)
        steps = []
        for o, rel in offsets:
            if rel:
                gap = (i + 1) / n - F.col(a) if o > 0 else F.col(a) - i / n
                gap = gap + (abs(o) - 1) / n if o else F.lit(0.0)
                steps.append(F.struct(F.pmod(i + o, F.lit(n)).cast("long").alias("c"), (gap * gap).alias("g")))
            else:
                steps.append(F.struct(F.lit(o).cast("long").alias("c"), F.lit(0.0).alias("g")))
        out = out.withColumn("_s", F.explode(F.array(*steps))).withColumns({"_g": F.col("_g") + F.col("_s.g"), f"_c{a}": F.col("_s.c")}).drop("_s").where(F.col("_g") <= most)
    return out.withColumn("cell", (F.col("_cx") * n + F.col("_cy")) * n + F.col("_cz")).drop("_g", "_cx", "_cy", "_cz")


def sides(r: float) -> int:
    """Cells per side for radius r: as many as keep a cell at least r wide."""
    if not 0 < r < 0.5:
        raise ValueError("the radius must be between 0 and half the box")
    return max(1, min(int(1.0 / r), 1 << 20))


def radius_join(left: DataFrame, right: DataFrame, r: float, periodic: bool = True, same: bool = False, by: list[str] = ()) -> DataFrame:
    """Pairs closer than ``r`` (strictly): ``i, j, dx, dy, dz, r2`` and the right side's ``wj`` if it has w.

    dx, dy, dz lead from j to i (x_i - x_j), by the nearest image if periodic. ``same`` leaves out i = j. Only rows with
    equal columns ``by``, which both sides have, meet; they are part of the join's key and of the result.
    """
    n = sides(r)
    by = list(by)
    w = [F.col("w").alias("wj")] if "w" in right.columns else []
    a = neighbour_cells(left.select("id", *AXES, *by), n, r).select(F.col("id").alias("i"), *[F.col(c).alias(f"{c}i") for c in AXES], "cell", *by)
    b = right.select(F.col("id").alias("j"), *[F.col(c).alias(f"{c}j") for c in AXES], *w, cell_of(n).alias("cell"), *by)
    d = {f"d{c}": F.col(f"{c}i") - F.col(f"{c}j") for c in AXES}
    if periodic:
        d = {k: min_image(v) for k, v in d.items()}
    # merged, not broadcast: the work is in the candidates, which one side's few files must not hold in a few tasks
    out = a.join(b.hint("merge"), ["cell", *by]).withColumns(d).withColumn("r2", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")).where(F.col("r2") < r * r)
    if same:
        out = out.where("i <> j")
    return out.select("i", "j", "dx", "dy", "dz", "r2", *(["wj"] if w else []), *by)


def count_pairs(points: DataFrame, r: float) -> DataFrame:
    """``n_pairs``: unordered pairs closer than r, each of which both of its points count."""
    from orrery.operators.tiles import Count, pair_sums

    return pair_sums(points, None, Count(r)).agg(F.expr("coalesce(sum(n), 0) div 2").alias("n_pairs"))


def neighbour_counts(points: DataFrame, r: float) -> DataFrame:
    """``id, n``: neighbours closer than r, zero included."""
    from orrery.operators.tiles import Count, pair_sums

    n = pair_sums(points, None, Count(r))
    return points.select("id").join(n, F.col("id") == F.col("i"), "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def neighbour_vectors(points: DataFrame, links: DataFrame) -> DataFrame:
    """``i, j, dx, dy, dz``: nearest-image displacement from i to each stored neighbour j."""
    a = points.select(F.col("id").alias("i"), *[F.col(c).alias(f"{c}i") for c in AXES])
    b = points.select(F.col("id").alias("j"), *[F.col(c).alias(f"{c}j") for c in AXES])
    both = links.select("i", "j").join(a, "i").join(b, "j")
    return both.select("i", "j", *[min_image(F.col(f"{c}j") - F.col(f"{c}i")).alias(f"d{c}") for c in AXES])


def pad_periodic(points: DataFrame, r: float) -> DataFrame:
    """Ghost images within r of the faces: ``id, sx, sy, sz`` (shifts, not all 0) and shifted positions."""
    if not 0 <= r < 0.5:
        raise ValueError("the padding must be below half the box")
    out = points
    for a in AXES:
        shifts = F.array_compact(F.array(F.lit(0), F.when(F.col(a) < r, 1), F.when(F.col(a) >= 1 - r, -1)))
        out = out.withColumn(f"s{a}", F.explode(shifts))
    out = out.where("sx <> 0 or sy <> 0 or sz <> 0")
    return out.withColumns({a: F.col(a) + F.col(f"s{a}") for a in AXES})


def subcube_flags(points: DataFrame, centre: tuple[float, float, float], half: float, ghost: float) -> DataFrame:
    """Per point: inside a periodic cube, inside or its ghost zone, outside with the inner rim, outside.

    ``inside`` is strict in max-norm; ``inside_ghost`` rounds the corners (distance to the cube below
    ``ghost``); ``outside_ghost`` is what the outside needs, down to ``ghost`` below the faces.
    """
    if half >= 0.5:
        raise ValueError("the half width must be below half the box")
    q = [F.abs(min_image(F.col(a) - c)) for a, c in zip(AXES, centre, strict=True)]
    top = F.greatest(*q)
    over = [F.greatest(v - half, F.lit(0.0)) for v in q]
    dist2 = over[0] * over[0] + over[1] * over[1] + over[2] * over[2]
    return points.select("id", (top < half).alias("inside"), (dist2 < ghost * ghost).alias("inside_ghost"), (top > half - ghost).alias("outside_ghost"), (top >= half).alias("outside"))


def running_sums(rows: DataFrame, by: list[str], place: str, value: str, width: int) -> DataFrame:
    """``rows`` with ``upto``: the sum of ``value`` over the rows of the same ``by`` up to this ``place``, itself included.

    Places are whole numbers, one row each. Sums run inside blocks of ``width`` places, and over the blocks' totals;
    with a width of the root of the range of places, no window is longer than that.
    """
    rows = rows.withColumn("_block", F.floor(F.col(place) / width).cast("long"))
    line = Window.partitionBy(*by).orderBy("_block")
    before = rows.groupBy(*by, "_block").agg(F.sum(value).alias("_k")).select(*by, "_block", (F.sum("_k").over(line) - F.col("_k")).alias("_before"))
    inner = F.sum(value).over(Window.partitionBy(*by, "_block").orderBy(place))
    return rows.join(before, [*by, "_block"]).withColumn("upto", inner + F.col("_before")).drop("_block", "_before")


def cell_runs(points: DataFrame, n: int) -> DataFrame:
    """``cell, start, stop``: where each filled cell's points lie when points are sorted by cell."""
    count = points.groupBy(cell_of(n).alias("cell")).agg(F.count(F.lit(1)).alias("k"), F.min(F.lit(0)).alias("all"))
    runs = running_sums(count, ["all"], "cell", "k", max(1, int(n**1.5)))
    return runs.select("cell", (F.col("upto") - F.col("k")).alias("start"), F.col("upto").alias("stop"))


#: Bins per axis of the first pass over events.
SHIFT_BINS = 1 << 14


def best_shift(points: DataFrame, r: float, bins: int = SHIFT_BINS) -> DataFrame:
    """Per axis, the middle of the stretch of the circle that fewest padded points [p - r, p + r) cover.

    A sweep over +1/-1 events in two levels. Events are first added up in bins (a partial aggregation), whose running sums
    give the cover at either end of each; a bin cannot go below what it starts with less its -1 events. Only the events
    of bins that may hold the least cover are sorted, each bin by itself. ``axis, cover, cut``.
    """
    items = []
    for a in AXES:
        lo, hi = wrap(F.col(a) - r), wrap(F.col(a) + r)
        items += [F.struct(F.lit(a).alias("axis"), lo.alias("p"), F.lit(1).alias("d"), (lo > hi).cast("int").alias("open")), F.struct(F.lit(a).alias("axis"), hi.alias("p"), F.lit(-1).alias("d"), F.lit(0).alias("open"))]
    events = points.select(F.inline(F.array(*items))).withColumn("bin", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)))
    held = events.groupBy("axis", "bin").agg(F.sum("d").alias("d"), F.sum((F.col("d") < 0).cast("long")).alias("ends"), F.sum("open").alias("open"), F.min("p").alias("first"))
    axis = Window.partitionBy("axis")
    line = axis.orderBy("bin")  # as many rows as bins
    after = F.sum("open").over(axis) + F.sum("d").over(line)
    held = held.withColumns({"start": after - F.col("d"), "after": after, "nxt": F.coalesce(F.lead("first").over(line), F.min("first").over(axis) + 1)})
    held = held.withColumn("least", F.min("after").over(axis)).where(F.col("start") - F.col("ends") <= F.col("least")).select("axis", "bin", "start", "nxt")
    at = events.join(F.broadcast(held), ["axis", "bin"]).groupBy("axis", "bin", "p", "start", "nxt").agg(F.sum("d").alias("d"))
    own = Window.partitionBy("axis", "bin").orderBy("p")
    swept = at.withColumns({"cover": F.col("start") + F.sum("d").over(own), "stop": F.coalesce(F.lead("p").over(own), F.col("nxt"))})
    best = swept.groupBy("axis").agg(F.min(F.struct("cover", "p", "stop")).alias("b"))
    return best.select("axis", F.col("b.cover").alias("cover"), wrap((F.col("b.p") + F.col("b.stop")) / 2).alias("cut"))


def shift_optimally(points: DataFrame, r: float, bins: int = SHIFT_BINS) -> DataFrame:
    """``points`` moved round the box so that the best cut of each axis (``best_shift``) lies at 0."""
    cut = {x["axis"]: x["cut"] for x in best_shift(points, r, bins).collect()}  # three rows
    return points.withColumns({a: wrap(F.col(a) + (1.0 - cut[a])) for a in AXES}) if cut else points
