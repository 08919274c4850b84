"""Particle sets: views over the sample tables and generated sets.

A particle set is ``id BIGINT, x, y, z DOUBLE`` in the periodic unit cube, with weight ``w`` and
velocities ``vx, vy, vz`` where an operator wants them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One particle per order; positions and velocities from integer arithmetic, so any engine agrees."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    frac = lambda v, m: (v % m) / F.lit(float(m))
    return table(spark, sf_dir, "orders").select(
        k.alias("id"),
        frac(k * 7919 + 104729, 1000003).alias("x"),
        frac(c * 15485863 + k * 31, 999983).alias("y"),
        frac(k * 32452843 + c * 17, 999979).alias("z"),
        (1 + k % 7).cast("double").alias("w"),
        ((k % 11 - 5) / F.lit(64.0)).alias("vx"),
        ((c % 13 - 6) / F.lit(64.0)).alias("vy"),
        (((k + c) % 17 - 8) / F.lit(64.0)).alias("vz"),
    )


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One particle per embedding, from its first three components."""
    e = F.col("embedding")
    axis = lambda i: ((F.element_at(e, i).cast("double") + 1) / 2)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), axis(1).alias("x"), axis(2).alias("y"), axis(3).alias("z"), (1 + F.col("vec_id") % 7).cast("double").alias("w"))


def lattice_points(spark: SparkSession, n: int, box: float = 1.0) -> DataFrame:
    """n**3 points at the corners of a regular lattice (no half-cell offset) with their cell size."""
    c = F.col("id")
    step = box / n
    return spark.range(n**3).select("id", (F.expr(f"id div {n * n}") * step).alias("x"), (F.expr(f"(id div {n}) % {n}") * step).alias("y"), ((c % n) * step).alias("z"), F.lit(step).alias("size"))


def tile(unit: DataFrame, repeat: int = 2, box: float = 1.0) -> DataFrame:
    """Repeat a unit-cube point set ``repeat`` times along each axis and scale it to ``box``.

    Ids are those of the unit set times the number of copies plus the copy, so they stay unique.
    """
    m = repeat**3
    copies = unit.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    place = lambda a, d: ((F.col(a) + F.expr(f"(_c div {d}) % {repeat}")) * (box / repeat)).alias(a)
    total = unit.count() * m
    size = box / total ** (1 / 3) if total else 0.0
    return copies.select((F.col("id") * m + F.col("_c")).alias("id"), place("x", repeat * repeat), place("y", repeat), place("z", 1), F.lit(size).alias("size"))


def tiled_uniform(unit: DataFrame, gridsize: int, unit_side: int = 64, box: float = 1.0) -> DataFrame:
    """Tile a unit set of ``unit_side``**3 points to ``gridsize`` per side, which must be a multiple."""
    if gridsize % unit_side:
        raise ValueError(f"the grid size must be a multiple of {unit_side}")
    return tile(unit, gridsize // unit_side, box)


def replace_in_sphere(coarse: DataFrame, fine: DataFrame, centre: tuple[float, float, float], radius: float) -> DataFrame:
    """Coarse points outside a sphere and fine points inside it; ``fine`` ids follow the coarse ones."""
    r2 = sum(((F.col(a) - c) * (F.col(a) - c) for a, c in zip("xyz", centre, strict=True)), F.lit(0.0))
    top = coarse.agg((F.coalesce(F.max("id"), F.lit(-1)) + 1).alias("_top"))
    inner = fine.where(r2 < radius * radius).join(F.broadcast(top), F.lit(True))
    return coarse.where(r2 >= radius * radius).unionByName(inner.withColumn("id", F.col("id") + F.col("_top")).drop("_top"))
