"""Domain decomposition: balancing cells over domains, and the ghosts that each domain needs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.operators.cells import cell_of, neighbour_cells, running_sums
from orrery.operators.lattice import counts
from orrery.sources.staging import cut

#: A mask column holds so many domains; rows (``ghost_rows``) hold any number.
MASK_BITS = 63


def grow_regions(cells: DataFrame, n: int, target: int) -> DataFrame:
    """``cell, domain``: greedy regions over periodic face neighbours of ``cells(cell, weight)``.

    Starts at the heaviest free cell (the first of ties), takes the heaviest free neighbour each time
    (the newest of ties) until the domain's weight reaches ``target``; a stuck region goes on from the
    next peak with the same count. The order is a chain, so the lattice (not the points) goes to one task.
    """

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        w = np.zeros(n**3, np.int64)
        w[pdf["cell"].to_numpy()] = pdf["weight"].to_numpy()
        return pd.DataFrame({"cell": np.arange(n**3), "domain": _grow(w, n, target)})

    return cells.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(grow, "cell long, domain int")


def _grow(weight: np.ndarray, n: int, target: int) -> np.ndarray:
    import heapq

    label = np.zeros(len(weight), np.int32)
    peaks = np.argsort(-weight, kind="stable").tolist()
    domain, have, stamp = 1, 0, 0
    queue: list[tuple[int, int, int]] = []
    queued = np.zeros(len(weight), bool)
    at = 0
    while True:
        if queue:
            c = heapq.heappop(queue)[2]
        else:
            while at < len(peaks) and label[peaks[at]]:
                at += 1
            if at == len(peaks):
                return label
            c = peaks[at]
        label[c] = domain
        queued[c] = True
        have += int(weight[c])
        if have >= target:
            domain, have = domain + 1, 0
            for _, _, q in queue:
                queued[q] = False
            queue = []
            continue
        i, j, k = c // (n * n), c // n % n, c % n
        for a, b, d in (((i - 1) % n, j, k), ((i + 1) % n, j, k), (i, (j - 1) % n, k), (i, (j + 1) % n, k), (i, j, (k - 1) % n), (i, j, (k + 1) % n)):
            m = (a * n + b) * n + d
            if not label[m] and not queued[m]:
                queued[m] = True
                stamp += 1
                heapq.heappush(queue, (-int(weight[m]), -stamp, m))


def square_weights(points: DataFrame, n: int, domains: int) -> tuple[DataFrame, int]:
    """Cell weights (1e4 * count / most)**2 as integers, and the weight a domain should reach."""
    c = counts(points, n)
    most = c.agg(F.max("n")).first()[0] or 1
    v = F.col("n") * 10_000.0 / most
    w = c.select("cell", F.floor(v * v).cast("long").alias("weight"))
    return w, (w.agg(F.sum("weight")).first()[0] or 0) // domains + 1


def ghost_rows(points: DataFrame, cell_domain: DataFrame, n: int, r: float) -> DataFrame:
    """``id, domain, own``: each point's domain, and every other domain with a cell within r of it."""
    if r * n > 1:
        raise ValueError("the radius must not pass the cell width")
    near = neighbour_cells(points.select("id", "x", "y", "z").withColumn("home", cell_of(n)), n, r * 1.001)
    hit = near.join(cell_domain, "cell").groupBy("id", "domain").agg(F.max((F.col("cell") == F.col("home")).cast("int")).alias("own"))
    return hit.select("id", "domain", (F.col("own") == 1).alias("own"))


def ghost_masks(points: DataFrame, cell_mask: DataFrame, n: int, r: float) -> DataFrame:
    """``id, mask``: bitwise or of ``cell_mask(cell, bits)`` over the cells within r (inflated by 0.1 %)."""
    if r * n > 1:
        raise ValueError("the radius must not pass the cell width")
    near = neighbour_cells(points.select("id", "x", "y", "z"), n, r * 1.001).select("id", "cell")
    return near.join(cell_mask, "cell").groupBy("id").agg(F.bit_or("bits").alias("mask"))


def balanced_domains(points: DataFrame, r: float, domains: int = 64, n: int | None = None) -> DataFrame:
    """``id, domain, own`` rows of domains that balance the squared cell counts, ghosts within r included."""
    n = n or max(1, int(0.15 / r))
    weights, target = square_weights(points, n, domains)
    return ghost_rows(points, grow_regions(weights, n, target), n, r)


def per_domain(points: DataFrame, rows: DataFrame, work, schema: str) -> DataFrame:
    """Run ``work(pandas frame with own)`` once per domain over its points and ghosts."""
    return rows.join(points, "id").groupBy("domain").applyInPandas(work, schema)


def ghost_stats(rows: DataFrame) -> DataFrame:
    """``domain, real, total``: own points, and points with ghosts."""
    return rows.groupBy("domain").agg(F.sum(F.col("own").cast("long")).alias("real"), F.count(F.lit(1)).alias("total"))


def bisect(points: DataFrame, n: int) -> DataFrame:
    """Per axis, the slab count after which the two sides' points are most even: ``axis, split, below, above``."""
    parts = None
    for a in ("x", "y", "z"):
        p = points.groupBy(F.floor(F.col(a) * n).cast("long").alias("slab")).agg(F.count(F.lit(1)).alias("k")).withColumn("axis", F.lit(a))
        parts = p if parts is None else parts.unionByName(p)
    line = Window.partitionBy("axis").orderBy("slab")
    run = parts.withColumns({"below": F.sum("k").over(line), "all": F.sum("k").over(Window.partitionBy("axis"))}).where(F.col("slab") < n - 1)
    best = run.groupBy("axis").agg(F.min(F.struct(F.abs(F.col("all") - 2 * F.col("below")).alias("gap"), "slab", "below", "all")).alias("b"))
    return best.select("axis", (F.col("b.slab") + 1).alias("split"), F.col("b.below").alias("below"), (F.col("b.all") - F.col("b.below")).alias("above"))


def least_load(sums: DataFrame, by: list[str]) -> DataFrame:
    """``by, split, left, load``: where to part lines of slabs over workers so that the worse side's load is least.

    ``sums``: ``by, place, upto, m, growth``, the running sums of a line of slabs 1 to M with an edge slab at either end
    (places 0 and M + 1), the workers of the line, and how a side's points grow with the logarithm of its workers, for
    the ghosts of later cuts. Each side gets its slabs and the next one beyond the cut, and a share of workers by its
    points, rounded down (or one more, if that is no worse). Of equal loads the first slab counts. Lines of fewer than two
    slabs or workers give no row.
    """
    line = Window.partitionBy(*by).orderBy("place")
    m, L, R = F.col("m"), F.col("_l"), F.col("_r")
    c = sums.withColumns({"_l": F.lead("upto").over(line), "_all": F.max("upto").over(Window.partitionBy(*by)), "_low": F.lag("upto").over(line), "_last": F.max("place").over(Window.partitionBy(*by))})
    c = c.where((F.col("place") > 0) & (F.col("place") < F.col("_last") - 1) & (m > 1)).withColumn("_r", F.col("_all") - F.col("_low"))
    share = F.when(L + R > 0, F.floor(m * L / (L + R))).otherwise(0).cast("int")
    c = c.withColumn("_m0", F.least(F.greatest(share, F.lit(1)), m - 1)).withColumn("_m1", F.least(F.col("_m0") + 1, m - 1))
    side = lambda pts, k: (1 + F.col("growth") * F.ln(k)) * pts / k
    load = lambda k: F.greatest(side(L, F.col(k)), side(R, m - F.col(k)))
    best = c.groupBy(*by).agg(*(F.min(F.struct(load(k).alias("load"), F.col("place").alias("split"), F.col(k).alias("left"))).alias(f"b{i}") for i, k in enumerate(("_m0", "_m1"))))
    pick = F.when(F.col("b0.load") < F.col("b1.load"), F.col("b0")).otherwise(F.col("b1"))
    return best.withColumn("b", pick).select(*by, F.col("b.split").cast("long").alias("split"), F.col("b.left").cast("int").alias("left"), F.col("b.load").alias("load"))


def load_partition(points: DataFrame, axis: str, slabs: int, workers: int, growth: float) -> DataFrame:
    """``split, left, load``: the best cut of the unit interval's ``slabs`` along ``axis``, with periodic edge slabs."""
    k = points.groupBy(F.floor(F.col(axis) * slabs).cast("long").alias("slab")).agg(F.count(F.lit(1)).alias("k"))
    edges = F.array_compact(F.array(F.col("slab") + 1, F.when(F.col("slab") == 0, slabs + 1), F.when(F.col("slab") == slabs - 1, 0)))
    filled = k.select(F.explode(edges).alias("place"), "k")
    every = points.sparkSession.range(slabs + 2).select(F.col("id").alias("place"))
    line = every.join(filled, "place", "left").select(F.lit(0).alias("line"), "place", F.coalesce("k", F.lit(0)).alias("k"))
    sums = running_sums(line, ["line"], "place", "k", max(1, int(slabs**0.5)))
    return least_load(sums.withColumns({"m": F.lit(workers), "growth": F.lit(growth)}), ["line"]).drop("line")


def summed_area(padded: DataFrame, side: int) -> DataFrame:
    """``cell, sum``: over all cells of ``padded(i, j, k, n)``, a full lattice of ``side`` per axis, the sum of n up to each.

    One axis after the other; a window holds one line of the lattice.
    """
    out = padded
    for a in "ijk":
        line = Window.partitionBy(*[b for b in "ijk" if b != a]).orderBy(a)
        out = out.withColumn("n", F.sum("n").over(line))
    return out.select(((F.col("i") * side + F.col("j")) * side + F.col("k")).alias("cell"), F.col("n").alias("sum"))


#: Fixed value: the ghosts that a cut adds, as a share of the points, grow with 1.35 times the domains' width in cells.
GHOST_GROWTH = 1.35


def kd_boxes(points: DataFrame, n: int, domains: int) -> DataFrame:
    """``domain, i0, i1, j0, j1, k0, k1, total, shift_i, shift_j, shift_k``: the lattice of n per axis cut in boxes, a row each.

    The lattice is first turned so that its planes 0 lie where least points cross: between the two neighbouring planes
    that hold the fewest (``shift``; bounds of boxes are in turned cells, the upper ones excluded). Starting with the whole, a
    box that has several domains is cut at the slab, along the axis and with the shares of domains for which the worse side
    has the least load (``least_load``), its one cell of ghosts around counted on either side. ``total`` is a box's points
    with these ghosts; domains are numbered from 1 by falling total, then in the order of the cuts, breadth first.

    A summed-area table of the turned and padded lattice is written once. Each round takes the slab sums of all open
    boxes from it by an equi-join on corners (3 * n * 8 rows a box), so points and cells are not read again.
    """
    spark = points.sparkSession
    c = cut(counts(points, n), "counts")
    at = {"i": F.expr(f"cell div {n * n}"), "j": F.expr(f"cell div {n} % {n}"), "k": F.expr(f"cell % {n}")}
    planes = c.select(F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), v.alias("p"), F.col("n")) for a, v in at.items()))).alias("s")).groupBy("s.axis", "s.p").agg(F.sum("s.n").alias("n"))
    ring = Window.partitionBy("axis").orderBy("p")
    cross = planes.withColumn("n", F.col("n") + F.coalesce(F.lag("n").over(ring), F.max_by("n", "p").over(Window.partitionBy("axis"))))
    shift = {r["axis"]: int(r["p"]) for r in cross.groupBy("axis").agg(F.min_by("p", F.struct("n", "p")).alias("p")).collect()}
    turned = c.select(*(F.pmod(v - shift[a], F.lit(n)).alias(a) for a, v in at.items()), "n")
    for a in "ijk":  # a cell more at either end
        more = F.array_compact(F.array(F.col(a) + 1, F.when(F.col(a) == 0, n + 1), F.when(F.col(a) == n - 1, 0)))
        turned = turned.withColumn(a, F.explode(more))
    side = n + 2
    table = cut(summed_area(turned, side), "summed_area")
    growth = GHOST_GROWTH * (domains / n**3) ** (1 / 3)
    start = spark.range(1).select(F.lit("").alias("path"), *(F.lit(x).cast("long").alias(f"{a}{e}") for a in "ijk" for e, x in ((0, 0), (1, n))), F.lit(domains).alias("m"))
    ends = [[(-1, f"{a}0 - 1"), (1, f"if(axis = '{a}', {a}0 + place, {a}1 + 1)")] for a in "ijk"]
    corners = ", ".join(f"struct(({x}) * {side * side} + ({y}) * {side} + {z} as cell, {p * q * r} as sign, {x} >= 0 and {y} >= 0 and {z} >= 0 as present)" for p, x in ends[0] for q, y in ends[1] for r, z in ends[2])
    halves = [", ".join(f"if(b.axis = '{a}', {a}0 + b.split, {a}{e}) as {a}{e}" if e == 1 - right else f"{a}{e}" for a in "ijk" for e in (0, 1)) for right in (0, 1)]
    done, todo = None, start
    while True:
        # sums over the padded box up to each slab of each axis, by the eight corners of the table
        slabs = todo.selectExpr("*", "explode(array('i', 'j', 'k')) as axis").selectExpr("*", "explode(sequence(0L, case axis when 'i' then i1 - i0 when 'j' then j1 - j0 else k1 - k0 end + 1)) as place")
        lines = slabs.selectExpr("path", "m", "axis", "place", f"inline(array({corners}))").where("present")
        sums = lines.join(table, "cell").groupBy("path", "m", "axis", "place").agg(F.sum(F.col("sign") * F.col("sum")).alias("upto"), F.lit(growth).alias("growth"))
        best = least_load(sums, ["path", "axis"]).groupBy("path").agg(F.min(F.struct("load", "axis", "split", "left")).alias("b"))
        total = sums.groupBy("path").agg(F.max("upto").alias("total"))
        cutting = cut(todo.join(total, "path").join(best, "path", "left"), "cuts")
        # a box of one domain is done, and so is one of one cell, which cannot be cut
        ready = cutting.where("b is null").drop("b", "m")
        done = ready if done is None else done.unionByName(ready)
        todo = cutting.where("b is not null").selectExpr(f"inline(array({', '.join(f"struct(concat(path, '{r}') as path, {h}, {'m - b.left' if r else 'b.left'} as m)" for r, h in enumerate(halves))}))")
        if todo.isEmpty():
            break
    order = Window.orderBy(F.desc("total"), F.length("path"), "path")  # as many rows as domains
    return done.withColumns({"domain": F.row_number().over(order), **{f"shift_{a}": F.lit(shift[a]) for a in "ijk"}}).drop("path")


def kd_domains(points: DataFrame, n: int, domains: int) -> DataFrame:
    """``cell, domain``: the boxes of ``kd_boxes`` as cells of the lattice before it was turned."""
    out = kd_boxes(points, n, domains)
    for a in "ijk":
        out = out.withColumn(a, F.explode(F.sequence(F.col(f"{a}0"), F.col(f"{a}1") - 1)))
        out = out.withColumn(a, F.pmod(F.col(a) + F.col(f"shift_{a}"), F.lit(n)))
    return out.select(((F.col("i") * n + F.col("j")) * n + F.col("k")).alias("cell"), "domain")
