"""Friends-of-friends groups, connected components and group catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators.cells import cell_of, radius_join
from orrery.sources.staging import cut, drop


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``id, label`` (least id of its component) for ``nodes(id)`` and undirected ``links(src, dst)``.

    Rounds of two steps over links from a larger to a smaller end: all larger neighbours of a node are hung on its least
    neighbour (or itself), then all smaller neighbours of a node on the least of them. The links left are stars whose
    centres are the labels, after a number of rounds that grows with the logarithm of the components' diameters. Least
    ends are partial aggregations; joins with them can be split where one node has very many links. Each round is
    written, so a lost executor repeats one round at most.
    """
    pair = [F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")]
    e = cut(links.where("src <> dst").select(*pair).distinct(), "links")
    state = None
    while True:
        # of every node, all neighbours; the larger ones move to the least
        ends = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        root = ends.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        hung = ends.join(root, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # of every node, the smaller neighbours; they and the node itself move to the least
        root = hung.groupBy("a").agg(F.min("b").alias("m"))
        rest = hung.join(root, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = cut(rest.unionByName(root.withColumnRenamed("m", "b")).distinct(), "links")
        drop(e)
        e, before = new, state
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return nodes.select("id").join(e, F.col("id") == F.col("a"), "left").select("id", F.coalesce("b", "id").alias("label"))


def friends_of_friends(points: DataFrame, b: float) -> DataFrame:
    """``id, grp`` (least id of the group): points closer than b, periodically, are in one group."""
    links = radius_join(points, points, b).where("i < j").select(F.col("i").alias("src"), F.col("j").alias("dst"))
    return components(points.select("id"), links).withColumnRenamed("label", "grp")


def links(points: DataFrame, b: float) -> DataFrame:
    """``src, dst``: each pair of points closer than b, periodically, once, the smaller id first.

    The join finds a pair of points once, so pairs need no second look unless an id comes twice, which one sum by id tells.
    """
    out = radius_join(points, points, b).where("i < j").select(F.col("i").alias("src"), F.col("j").alias("dst"))
    again = points.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    return dedupe_links(out) if again else out


def dedupe_links(links: DataFrame) -> DataFrame:
    """Each undirected link once, the smaller end first."""
    return links.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").dropDuplicates(["src", "dst"])


def catalogue(groups: DataFrame, top: int | None = None, least: int = 1) -> DataFrame:
    """``grp, n`` of groups with at least ``least`` members, the ``top`` largest (ties: smaller label)."""
    out = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return out.orderBy(F.desc("n"), "grp").limit(top) if top else out


def mark_small(groups: DataFrame, least: int = 20, none: int = -1) -> DataFrame:
    """``id, grp`` with the label ``none`` for members of groups below ``least``."""
    size = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    return groups.join(size, "grp").select("id", F.when(F.col("n") >= least, F.col("grp")).otherwise(none).alias("grp"))


def halo_cells(points: DataFrame, n: int, level: int) -> DataFrame:
    """Face-connected (not periodic) regions of cells with over ``level`` points.

    ``label`` (least cell), ``cells``, ``n`` points, the bounding box in cells, its centre times two, and
    the largest half width times two, all whole numbers.
    """
    dense = cut(points.groupBy(cell_of(n).alias("id")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > level), "dense")
    i, j, k = F.expr(f"id div {n * n}"), F.expr(f"(id div {n}) % {n}"), F.col("id") % n
    steps = F.array(*[F.when(c < n - 1, F.col("id") + d) for c, d in ((i, n * n), (j, n), (k, 1))])
    edges = dense.select(F.col("id").alias("src"), F.explode(F.array_compact(steps)).alias("dst")).join(dense.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
    lab = components(dense.select("id"), edges).join(dense, "id").withColumns({"i": i, "j": j, "k": k})
    box = [f(c).alias(f"{c}_{s}") for c in "ijk" for s, f in (("min", F.min), ("max", F.max))]
    out = lab.groupBy("label").agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("n"), *box)
    centre = [(F.col(f"{c}_min") + F.col(f"{c}_max") + 1).alias(f"{c}_centre2") for c in "ijk"]
    width = F.greatest(*[F.col(f"{c}_max") - F.col(f"{c}_min") + 1 for c in "ijk"]).alias("width")
    return out.select("*", *centre, width)
