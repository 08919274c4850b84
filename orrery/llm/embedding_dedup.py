"""Embedding near-dedup by PCA-ordered tiled comparison.

Unit vectors are rotated so that their leading dimensions hold most of their length (an orthonormal
rotation keeps cosines, so it may be fitted on a bounded sample). A tile multiplies the leading dimensions
of its vectors first; the norms of the remaining parts bound what the rest can add, and pairs that cannot
reach the threshold stop there. Those that go on gain a run of dimensions at a time. Pairs that single
precision leaves within its error of the threshold are decided in double precision on the originals.

Plan at scale: a pair at the threshold is at most w = sqrt(2 - 2t) apart. The first two principal axes are cut in
cells a little wider than w; a vector belongs to its cell and visits a following cell only if it is within w of it. A
cell's vectors and its visitors are dealt over blocks of ``block``, so a dense cell is many tiles, not one
task. Vectors travel in the type of their column, which loses nothing. A tile returns link counts per vector
and a star per component it sees, never pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import vectors
from orrery.llm.components import components
from orrery.llm.scratch import Scratch

#: Cells of an axis, and the width of a cell in pair distances.
SIDE, WIDE = 64, 1.5


def rotation(x: np.ndarray) -> np.ndarray:
    """Orthonormal axes (columns) by falling second moment."""
    _, v = np.linalg.eigh(x.T @ x)
    return np.ascontiguousarray(v[:, ::-1])


def units(x: np.ndarray) -> np.ndarray:
    x = vectors.scaled(x)
    return x / np.sqrt((x**2).sum(1))[:, None]


class Cells:
    """The grid over the first two axes; vectors of other lengths than the usual one keep their own axes."""

    def __init__(self, axes: np.ndarray, threshold: float):
        self.axes, self.near = axes, math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
        self.width = max(WIDE * self.near, 2.2 / (SIDE // 2 - 1))

    def turn(self, u: np.ndarray) -> np.ndarray:
        return u @ self.axes if u.shape[1] == len(self.axes) else u

    def places(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vector, cell, visitor?) rows: its own cell, and following cells within reach."""
        lead = self.turn(units(x.astype(np.float64)))[:, :2]
        lead = np.c_[lead, np.zeros((len(lead), 2 - lead.shape[1]))] / self.width
        c = np.floor(lead).astype(np.int64)
        low, high = (lead - c) * self.width, (c + 1 - lead) * self.width
        code = (c[:, 0] + SIDE // 2) * SIDE + c[:, 1] + SIDE // 2
        row, cell, guest = [np.arange(len(x))], [code], [np.zeros(len(x), bool)]
        gap = {-1: low, 0: np.zeros_like(low), 1: high}
        for dx, dy in ((0, 1), (1, -1), (1, 0), (1, 1)):
            far = np.hypot(gap[dx][:, 0], gap[dy][:, 1])
            i = np.flatnonzero(far <= self.near)
            row.append(i)
            cell.append(code[i] + dx * SIDE + dy)
            guest.append(np.ones(len(i), bool))
        return np.concatenate(row), np.concatenate(cell), np.concatenate(guest)


def _count(cells: Cells):
    def run(batches):
        for b in batches:
            for dim, _, _, x in vectors.usable(b):
                _, cell, guest = cells.places(x)
                k, n = np.unique(np.c_[cell, guest], axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), dim, np.int32)), pa.array(k[:, 0].astype(np.int32)), pa.array(k[:, 1] > 0), pa.array(n)], names=["dim", "cell", "guest", "n"])

    return run


def _deal(cells: Cells, blocks: dict[tuple[int, int, bool], int]):
    """A vector goes to the tiles that its block forms with the blocks of its cell.

    Tiles (cell, i, j): home blocks i <= j, and home block i with the visitors' block j, numbered from below 0.
    Side 0 is block i, side 1 block j.
    """

    def run(batches):
        for b in batches:
            for dim, ids, times, x in vectors.usable(b):
                row, cell, guest = cells.places(x)
                mine = np.array([blocks[dim, c, g] for c, g in zip(cell.tolist(), guest.tolist(), strict=True)])
                home = np.array([blocks.get((dim, c, False), 0) for c in cell.tolist()])
                away = np.array([blocks.get((dim, c, True), 0) for c in cell.tolist()])
                with np.errstate(over="ignore"):
                    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).astype(np.uint64) @ np.arange(1, x.itemsize * dim + 1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
                    blk = ((h[row] >> np.uint64(20)) % mine.astype(np.uint64)).astype(np.int64)
                # one block of the other side at a time, so that a task holds one copy of its batch
                for r in range(int(home.max(initial=0))):
                    # a visitor meets every home block; a home block every home block, its own once
                    k = np.flatnonzero(r < home)
                    g, at = guest[k], row[k]
                    key = np.c_[cell[k], np.where(g, r, np.minimum(blk[k], r)), np.where(g, -1 - blk[k], np.maximum(blk[k], r)), np.where(g, 1, blk[k] > r)]
                    yield vectors.rows(key, dim, ids[at], times[at], np.ascontiguousarray(x[at]))
                for r in range(int(away.max(initial=0))):
                    k = np.flatnonzero((r < away) & ~guest)
                    at = row[k]
                    if len(at):
                        yield vectors.rows(np.c_[cell[k], blk[k], np.full(len(k), -1 - r), np.zeros(len(k), np.int64)], dim, ids[at], times[at], np.ascontiguousarray(x[at]))

    return run


def links(x: np.ndarray, y: np.ndarray, cells: Cells, t: float, lead: int = 8, run: int = 16, step: tuple[int, int] = (1024, 4096)):
    """Index pairs of rows of x and y (doubles) with cosine at least t, in parts."""
    x, y = vectors.scaled(x), vectors.scaled(y)
    nx, ny = np.sqrt((x**2).sum(1)), np.sqrt((y**2).sum(1))
    a, b = cells.turn(x / nx[:, None]).astype(np.float32), cells.turn(y / ny[:, None]).astype(np.float32)
    d = a.shape[1]
    # rounding of components and of sums of d products, for unit vectors
    eps = (d + 16) * 2.0**-23
    stops = [min(lead, d)]
    while stops[-1] < d:
        stops.append(min(d, stops[-1] + run))

    def rest(m):
        tail = np.cumsum((m[:, ::-1].astype(np.float64)) ** 2, 1)[:, ::-1]
        tail = np.c_[tail, np.zeros(len(m))]
        return np.sqrt(tail[:, stops]).astype(np.float32)

    ra, rb = rest(a), rest(b)
    for p in range(0, len(a), step[0]):
        for q in range(0, len(b), step[1]):
            u, v, ru, rv = a[p : p + step[0]], b[q : q + step[1]], ra[p : p + step[0]], rb[q : q + step[1]]
            k = stops[0]
            part = u[:, :k] @ v[:, :k].T
            alive = part + np.outer(ru[:, 0], rv[:, 0]) >= t - eps
            i, j = np.nonzero(alive)
            if len(i) > alive.size // 8:  # a dense tile: all dimensions at once
                full = u @ v.T
                i, j = np.nonzero(full >= t - eps)
                s = full[i, j]
            else:
                s = part[i, j]
                for n, to in enumerate(stops[1:], 1):
                    s = s + np.einsum("ij,ij->i", u[i, k:to], v[j, k:to])
                    k = to
                    keep = s + ru[i, n] * rv[j, n] >= t - eps
                    i, j, s = i[keep], j[keep], s[keep]
            i, j = i + p, j + q
            close = np.flatnonzero(s < t + eps)
            drop = np.zeros(len(i), bool)
            for c in range(0, len(close), 20000):
                e = close[c : c + 20000]
                drop[e] = vectors.inner(x[i[e]], y[j[e]]) / (nx[i[e]] * ny[j[e]]) < t
            yield i[~drop], j[~drop]


def roots(up: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index of each node's component, given those so far and further links."""
    up = up.copy()
    while len(i):
        a, b = up[i], up[j]
        if (a == b).all():
            break
        low = np.minimum(a, b)
        np.minimum.at(up, a, low)
        np.minimum.at(up, b, low)
        while True:
            nxt = up[up]
            if (nxt == up).all():
                break
            up = nxt
    return up


def _tile(cells: Cells, t: float, dtype):
    def run(table: pa.Table) -> pa.Table:
        dim, one = table.column("dim")[0].as_py(), table.column("b")[0] == table.column("c")[0]
        ids, times, x = vectors.side(table, 0, dim, dtype)
        if one:
            every, many, y, off = ids, times, x, 0
        else:
            jd, more, y = vectors.side(table, 1, dim, dtype)
            every, many, off = np.concatenate([ids, jd]), np.concatenate([times, more]), len(ids)
        o = np.argsort(every, kind="stable")
        at = np.empty(len(o), np.int64)
        at[o] = np.arange(len(o))
        n = np.zeros(len(every), np.int64)
        up = np.arange(len(every))
        for i, j in links(x, y, cells, t) if len(x) and len(y) else ():
            j = j + off
            ok = (every[i] != every[j]) & ((i < j) if one else True)
            i, j = i[ok], j[ok]
            weight = many[i] * many[j]
            np.add.at(n, i, weight)
            np.add.at(n, j, weight)
            up = roots(up, at[i], at[j])
        hit = np.flatnonzero(n)
        return pa.table({"node": pa.array(every[hit]), "n": pa.array(n[hit]), "root": pa.array(every[o][up[at[hit]]])})

    return run


def dedup(df: DataFrame, threshold: float = 0.95, block: int = 8192, sample: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Return ``vec_id, n_links, component_id, kept`` for every row of ``df``.

    Rows link when the cosine of their vectors, in double precision, is at least ``threshold`` (over 0).
    ``sample`` bounds the rows that the rotation is fitted on; it and ``block`` decide speed alone.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing: 0 links, their
    own component, kept. Vectors of different lengths do not link. A null id: 0 links, null component, kept
    null. Rows that repeat an id are one node: each row counts links with other ids, summed over the
    id's rows. Empty table: no rows.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "vectors")
    dim, dtype = vectors.usual(df, vec_col), vectors.kind(df, vec_col)
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    every = src.select(F.col("id").alias("vec_id"))
    some = src.where(F.size("v") == dim).orderBy(F.xxhash64("id"), "id").limit(sample).withColumn("times", F.lit(1).cast("long"))
    packed = some.mapInArrow(_raw, "raw binary").collect() if dim else []
    x = np.concatenate([np.frombuffer(r[0], dtype).reshape(-1, dim) for r in packed]).astype(np.float64) if packed else np.eye(max(dim, 1))
    cells = Cells(rotation(units(x)), threshold)
    src = vectors.counted(src)
    # at most 64 x 64 cells for each length that vectors have
    size = src.mapInArrow(_count(cells), "dim int, cell int, guest boolean, n long").groupBy("dim", "cell", "guest").agg(F.sum("n").alias("n"))
    blocks = {(r["dim"], r["cell"], r["guest"]): -(-r["n"] // block) for r in size.collect()}
    tiles = src.mapInArrow(_deal(cells, blocks), vectors.TILE).groupBy("dim", "a", "b", "c")
    found = scratch.cut(tiles.applyInArrow(_tile(cells, threshold, dtype), "node long, n long, root long"), "links")
    linked = components(found.select(F.col("node").alias("src"), F.col("root").alias("dst")), scratch)
    count = found.groupBy("node").agg(F.sum("n").alias("n_links"))
    named = count.join(linked, "node", "left").withColumnRenamed("node", "vec_id")
    out = every.join(named, "vec_id", "left")
    comp = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), (F.col("vec_id") == comp).alias("kept"))


def _raw(batches):
    for b in batches:
        for _, _, _, x in vectors.usable(b):
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], names=["raw"])
