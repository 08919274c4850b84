"""The smallest ellipsoid around points."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def directions(n: int) -> np.ndarray:
    """n directions spread over the sphere along a spiral, and the axes."""
    i = np.arange(n) + 0.5
    z, phi = 1 - 2 * i / n, np.pi * (1 + 5**0.5) * i
    s = np.sqrt(1 - z**2)
    return np.concatenate([np.stack([s * np.cos(phi), s * np.sin(phi), z], 1), np.eye(3), -np.eye(3)])


def extremes(points: DataFrame, n: int = 96) -> np.ndarray:
    """Points that are farthest in some direction: at most n + 6 of them, found in one aggregation."""
    aggs = [F.max_by(F.struct("x", "y", "z"), F.col("x") * float(d[0]) + F.col("y") * float(d[1]) + F.col("z") * float(d[2])).alias(f"d{k}") for k, d in enumerate(directions(n))]
    row = points.agg(*aggs).first()
    return np.unique(np.array([tuple(v) for v in row if v is not None], float).reshape(-1, 3), axis=0)


def khachiyan(x: np.ndarray, tol: float = 1e-3, rounds: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Matrix A and centre c of the smallest ellipsoid (x - c) A (x - c) <= 1."""
    n, d = x.shape
    q = np.c_[x, np.ones(n)].T
    u = np.full(n, 1 / n)
    for _ in range(rounds):
        m = np.einsum("ij,ji->i", q.T @ np.linalg.inv(q * u @ q.T), q)
        j = int(m.argmax())
        step = (m[j] - d - 1) / ((d + 1) * (m[j] - 1))
        new = (1 - step) * u
        new[j] += step
        gap, u = np.linalg.norm(new - u), new
        if gap <= tol:
            break
    c = x.T @ u
    return np.linalg.inv(x.T * u @ x - np.outer(c, c)) / d, c


def bounding_ellipsoid(points: DataFrame, tol: float = 1e-3, n: int = 96, rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """The smallest ellipsoid around all points, to a relative excess of ``tol``, grown so that every point is inside.

    Starts from extreme points of some directions and fits again with the point that lies farthest out, one pass over
    the rows each, until none is out by more than ``tol``: those left out so far do not matter to the fit.
    """
    support = extremes(points, n)
    for _ in range(rounds):
        a, c = khachiyan(support, tol / 10)
        d = [F.col(v) - float(o) for v, o in zip("xyz", c, strict=True)]
        r2 = sum((d[i] * d[j] * float(a[i, j]) for i in range(3) for j in range(3)), F.lit(0.0))
        far = points.agg(F.max(F.struct(r2.alias("r2"), "x", "y", "z")).alias("m")).first()["m"]
        if far is None or far["r2"] <= 1 + tol:
            break
        support = np.concatenate([support, [[far["x"], far["y"], far["z"]]]])
    return a / max(1.0, far["r2"] if far else 1.0), c
