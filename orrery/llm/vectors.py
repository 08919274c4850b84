"""Vectors in packed tiles: the common part of the two vector operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TILE = "dim int, a int, b int, c int, side int, ids binary, times binary, data binary"
_TILE = pa.schema([("dim", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("c", pa.int32()), ("side", pa.int32()), ("ids", pa.binary()), ("times", pa.binary()), ("data", pa.binary())])


def kind(df: DataFrame, vec_col: str):
    """NumPy type that holds the vectors' components exactly: float where the column is, else double."""
    return np.float32 if df.schema[vec_col].dataType.elementType == T.FloatType() else np.float64


def usual(df: DataFrame, vec_col: str) -> int:
    """The most frequent length (the smallest of ties); 0 for a table without vectors."""
    sizes = df.where(F.col(vec_col).isNotNull()).groupBy(F.size(vec_col).alias("d")).count()
    top = sizes.where("d > 0").orderBy(F.desc("count"), "d").first()
    return int(top["d"]) if top else 0


def counted(df: DataFrame) -> DataFrame:
    """(id, v) rows as (id, v, times): rows that repeat whole are folded, if any id repeats at all."""
    twice = df.where("id is not null").groupBy("id").count().where("count > 1")
    if twice.isEmpty():
        return df.withColumn("times", F.lit(1).cast("long"))
    return df.groupBy("id", "v").agg(F.count(F.lit(1)).alias("times"))


def usable(batch: pa.RecordBatch):
    """Of a batch (id, v, times): (dim, ids, times, vectors) per length, of rows that have an id and finite components, not all 0."""
    ids, vec = batch.column(0), batch.column(1)
    ok = np.asarray(ids.is_valid()) & np.asarray(vec.is_valid())
    size = np.where(ok, np.asarray(vec.value_lengths().fill_null(0)), 0)
    for dim in np.unique(size[size > 0]).tolist():
        pick = pa.array(np.flatnonzero(size == dim))
        x = vec.take(pick).flatten().to_numpy(zero_copy_only=False)
        x = x.astype(np.float32 if x.dtype == np.float32 else np.float64).reshape(-1, dim)
        good = np.isfinite(x).all(1) & (x != 0).any(1)
        if good.any():
            yield dim, ids.take(pick).to_numpy(zero_copy_only=False).astype(np.int64)[good], batch.column(2).take(pick).to_numpy(zero_copy_only=False).astype(np.int64)[good], x[good]


def rows(keys: np.ndarray, dim: int, ids: np.ndarray, times: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    """Packed rows for tiles: one for each distinct (a, b, c, side) of ``keys``, with its vectors."""
    _, tile, inv = np.unique(keys, axis=0, return_index=True, return_inverse=True)
    o = np.argsort(inv.ravel(), kind="stable")
    cut = np.r_[np.searchsorted(inv.ravel()[o], np.arange(len(tile))), len(o)]
    part = [o[i:j] for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    k = keys[tile].astype(np.int32)
    cols = [np.full(len(tile), dim, np.int32), k[:, 0], k[:, 1], k[:, 2], k[:, 3]]
    return pa.RecordBatch.from_arrays([*map(pa.array, cols), *(pa.array([v[p].tobytes() for p in part], pa.binary()) for v in (ids, times, x))], schema=_TILE)


def side(t: pa.Table, which: int, dim: int, dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, times and vectors of one side of a tile, by id and then by content."""
    t = t.filter(pa.array(t.column("side").to_numpy() == which))
    ids, times, data = (b"".join(t.column(n).to_pylist()) for n in ("ids", "times", "data"))
    ids, times, x = np.frombuffer(ids, np.int64), np.frombuffer(times, np.int64), np.frombuffer(data, dtype).reshape(-1, dim)
    o = np.lexsort((x[:, 0], ids))
    return ids[o], times[o], x[o].astype(np.float64)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two (which is exact) that brings the largest component to 0.5 .. 1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None]) if len(x) else x


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, added from the first component on (the same for any blocking)."""
    out = np.zeros(len(a))
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        for j in range(a.shape[1]):
            out += a[:, j] * b[:, j]
    return out
