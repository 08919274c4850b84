"""Connected components of an edge table, by stars of each task's edges and jumps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.scratch import Scratch

#: Edges that a task holds at once.
_HELD = 1 << 20


def stars(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges that have a smaller one within reach, each once, and the smallest node that they reach."""
    node, at = np.unique(np.concatenate([hi, lo]), return_inverse=True)
    a, b = at[: len(hi)], at[len(hi) :]
    up = np.arange(len(node))
    while True:
        a, b = up[a], up[b]
        apart = a != b
        a, b = np.maximum(a, b)[apart], np.minimum(a, b)[apart]
        if not len(a):
            break
        np.minimum.at(up, a, b)
        while ((above := up[up]) != up).any():
            up = above
    low = np.flatnonzero(up != np.arange(len(node)))
    return node[low], node[up[low]]


def _stars(batches):
    """Edges (hi, lo) of a task as ``stars``, some _HELD at once; those of one hi together, where they come together."""
    held, count = [], 0

    def out(h, v):
        h, v = stars(h, v)
        for k in range(0, len(h), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(h[k : k + (1 << 16)]), pa.array(v[k : k + (1 << 16)])], names=["hi", "lo"])

    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        count += b.num_rows
        if count < _HELD:
            continue
        hi, lo = (np.concatenate(x) for x in zip(*held, strict=True))
        turn = np.flatnonzero(hi[1:] != hi[:-1])
        cut = int(turn[-1]) + 1 if len(turn) else len(hi)  # the last hi may go on; a task sends each one once, so none has so many rows
        yield from out(hi[:cut], lo[:cut])
        held, count = [(hi[cut:], lo[cut:])], 0
    if held:
        yield from out(*(np.concatenate(x) for x in zip(*held, strict=True)))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Return ``node, component`` (the smallest node reachable) for each node of ``edges(src, dst)``.

    Each task replaces its edges by stars, which keep what they connect: a row for each node but the
    smallest. A round hangs every node below the smallest one above its own (a join, which Spark can split when one
    node has a large share of the edges), brings the edges of a node together, at most one from each task, makes
    stars of each task's edges again, and writes them. No round adds rows or raises an end, so the first that leaves
    their number and the sum of their smaller ends has changed nothing: all are stars then. Edges with
    a null end or equal ends are ignored; no edges give no rows.
    """
    form = "hi long, lo long"
    e = edges.where("src is not null and dst is not null and src <> dst")
    e = e.select(F.greatest("src", "dst").cast("long").alias("hi"), F.least("src", "dst").cast("long").alias("lo"))
    met = lambda d: d.repartition("hi").sortWithinPartitions("hi").mapInArrow(_stars, form)
    e = scratch.cut(met(e.mapInArrow(_stars, form)), "edges")
    mark = _mark(e)
    while mark[0]:
        above = e.groupBy("hi").agg(F.min("lo").alias("above")).withColumnRenamed("hi", "lo")
        new = scratch.cut(met(e.join(above, "lo", "left").select("hi", F.coalesce("above", "lo").alias("lo"))), "edges")
        scratch.drop(e)
        e, old = new, mark
        mark = _mark(e)
        if mark == old:
            break
    roots = e.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.col("lo").cast("decimal(38,0)"))).first())
