"""Approximate nearest neighbours as a block matrix join.

Vectors and queries are quantised to int8, each with a scale of its own. A tile multiplies blocks of query codes
with blocks of vector codes; the norms of the quantisation errors bound how far each quantised product is
from the true one. Pairs whose upper bound reaches the k-th best lower bound survive, are recomputed in
double precision on the original vectors, and are merged by heaps. As the bounds hold, no true neighbour is
lost: the recall is 1.

Plan at scale: the work is (queries x vectors), in tiles of ``query_rows`` and ``vector_rows`` that any number of
tasks share. A vector travels once for each block of queries, a query once for each block of vectors, in the
type of their column; nothing is broadcast, and two counts come to the driver. A tile returns k rows per
query, and the last merge sees k rows per query and block of vectors.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.llm import vectors

#: Bounds are compared in doubles whose own rounding this covers.
_ROUND = 1e-9


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms of the coded vectors, and norms of the errors."""
    scale = np.abs(x).max(1) / 127
    code = np.rint(x / scale[:, None]).astype(np.int8)
    coded = code * scale[:, None]
    return code, scale, np.sqrt((coded**2).sum(1)), np.sqrt(((x - coded) ** 2).sum(1))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact int8 products as float; up to 1,024 components at once stay below 2**24."""
    out = np.zeros((len(a), len(b)), np.float64)
    for j in range(0, a.shape[1], 1024):
        out += a[:, j : j + 1024].astype(np.float32) @ b[:, j : j + 1024].astype(np.float32).T
    return out


def _tame(x: np.ndarray) -> np.ndarray:
    """Rows whose products with each other neither overflow nor vanish, so that bounds hold."""
    top = np.abs(x).max(1)
    return (top > 1e-100) & (top < 1e100)


def _deal(queries: int, groups: int):
    """A query goes to its block's tiles with every group of vectors, a vector to its group's with every block."""

    def run(batches):
        for b in batches:
            for dim, ids, times, x in vectors.usable(b.select([0, 1, 2])):
                asks = b.column(3)[0].as_py()
                with np.errstate(over="ignore"):
                    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)
                mine, others = (queries, groups) if asks else (groups, queries)
                own = (h % np.uint64(mine)).astype(np.int64)
                for o in range(others):
                    other, zero = np.full(len(ids), o), np.zeros(len(ids), np.int64)
                    keys = np.c_[own, other, zero, zero] if asks else np.c_[other, own, zero, zero + 1]
                    yield vectors.rows(keys, dim, ids, times, x)

    return run


def _tile(k: int, dtype, step: int = 256, block: int = 2048):
    def run(t: pa.Table) -> pa.Table:
        dim = t.column("dim")[0].as_py()
        qid, _, qx = vectors.side(t, 0, dim, dtype)
        vid, _, vx = vectors.side(t, 1, dim, dtype)
        heaps: list[list[tuple[float, int]]] = [[] for _ in qid]
        if len(qid) and len(vid):
            qt, vt = _tame(qx), _tame(vx)
            code, scale, coded, err = quantise(np.where(qt[:, None], qx, 1.0))
            for v in range(0, len(vid), block):
                vids, raw = vid[v : v + block], vx[v : v + block]
                first = np.flatnonzero(np.r_[True, vids[1:] != vids[:-1]])
                calm = np.where(vt[v : v + block, None], raw, 1.0)
                vcode, vscale, _, verr = quantise(calm)
                full = np.sqrt((calm**2).sum(1))
                for s in range(0, len(qid), step):
                    e = slice(s, s + step)
                    near = product(code[e], vcode) * np.outer(scale[e], vscale)
                    slack = np.outer(coded[e], verr) + np.outer(err[e], full) + _ROUND * np.outer(coded[e] + err[e], full)
                    slack = np.where(qt[e][:, None] & vt[None, v : v + block], slack, np.inf)  # nothing is known: such a pair survives
                    own = qid[e][:, None] == vids[None, :]
                    low = np.where(own, -np.inf, near - slack)
                    if len(first) < len(vids):  # an id counts once
                        low = np.maximum.reduceat(low, first, axis=1)
                    kth = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(low), -np.inf)
                    best = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps[e]])
                    i, j = np.nonzero((near + slack >= np.maximum(kth, best)[:, None]) & ~own)
                    exact = np.concatenate([vectors.inner(qx[e][i[c : c + 20000]], raw[j[c : c + 20000]]) for c in range(0, len(i), 20000)]) if len(i) else np.empty(0)
                    exact[np.isnan(exact)] = -np.inf
                    for a, w, sc in zip(i.tolist(), vids[j].tolist(), exact.tolist(), strict=True):
                        _offer(heaps[s + a], (sc, -w), k)
        out = [(a, -v, sc) for a, h in zip(qid.tolist(), heaps, strict=True) for sc, v in h]
        return pa.table({"query_id": pa.array([x[0] for x in out], pa.int64()), "vec_id": pa.array([x[1] for x in out], pa.int64()), "score": pa.array([x[2] for x in out], pa.float64())})

    return run


def _offer(heap: list[tuple[float, int]], item: tuple[float, int], k: int) -> None:
    """Keep the k best (score, -id), each id once with its best score."""
    if len(heap) == k and item <= heap[0]:
        return
    for n, (score, v) in enumerate(heap):
        if v == item[1]:
            if item[0] > score:
                heap[n] = item
                heapq.heapify(heap)
            return
    if len(heap) < k:
        heapq.heappush(heap, item)
    else:
        heapq.heapreplace(heap, item)


def search(base: DataFrame, queries: DataFrame, k: int = 20, query_rows: int = 16_384, vector_rows: int = 8192, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Return ``query_id, rank, vec_id, score``: each query's ``k`` rows with the largest inner product.

    Own rows (equal ids) are no candidates. Ties go to the smaller id. Rows with a null id, and vectors
    that are null, empty, zero, or hold null or non-finite components, take no part; a vector is a candidate for
    queries of its own length. A repeated id is searched with each of its vectors and listed once, with its
    best score. A product that overflows is infinite, and one that overflows both ways counts as the least; vectors
    beyond 1e100 or below 1e-100 are compared without bounds. Fewer candidates than ``k``: all of them. Empty tables: no rows.
    """
    dtype = vectors.kind(base, vec_col)
    pick = [F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")]
    asked, every = vectors.counted(queries.select(*pick)), vectors.counted(base.select(*pick))
    blocks, groups = max(1, -(-queries.count() // query_rows)), max(1, -(-base.count() // vector_rows))
    deal = _deal(blocks, groups)
    rows = [df.select("id", "v", "times", F.lit(asks).alias("asks")).mapInArrow(deal, vectors.TILE) for df, asks in ((asked, True), (every, False))]
    found = rows[0].union(rows[1]).groupBy("dim", "a", "b").applyInArrow(_tile(k, dtype), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
