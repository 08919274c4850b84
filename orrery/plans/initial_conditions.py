"""Initial conditions end to end: spectrum to displacements to particles to a snapshot and back to a spectrum."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.cosmology import normalised, particle_mass, velocity_factor
from orrery.operators.cells import wrap
from orrery.operators.fourier import boost, density_modes, displacement, spectrum
from orrery.operators.lattice import deposit, gather_displacement, save_levels
from orrery.sources.particle_files import write_spectrum
from orrery.sources.snapshots import read_gadget, write_gadget


def displacements(spark: SparkSession, p, n: int, box: float, seed: int, sigma8: float, a: float, om: float, ol: float, path: str | None = None) -> DataFrame:
    """Displacement lattice of a spectrum normalised at a; written with its coarser levels if asked."""
    out = displacement(spark, normalised(p, sigma8, a, om, ol), n, box, seed)
    if path:
        save_levels(out, n, path)
    return out


def displacement_boost(spark: SparkSession, p, n: int, box: float, repeat: int, orig_n: int, seed: int, sigma8: float, a: float, om: float, ol: float) -> DataFrame:
    return boost(spark, normalised(p, sigma8, a, om, ol), n, box, repeat, orig_n, seed)


def size_classes(points: DataFrame) -> DataFrame:
    """``size, n``: how many cells of each size."""
    return points.groupBy("size").agg(F.count(F.lit(1)).alias("n"))


def fills_box(points: DataFrame, box: float, tol: float = 1e-5) -> bool:
    """Whether the cells' volumes add up to the box."""
    v = points.agg(F.sum(F.col("size") * F.col("size") * F.col("size"))).first()[0] or 0.0
    return abs(v / box**3 - 1) < tol


def mass_field(points: DataFrame, lattice: DataFrame, n: int, box: float, a: float, h0: float, om: float, ol: float, h: float = 1.0, ob: float = 0.0, boost_lattice: DataFrame | None = None, boost_n: int = 0, repeat: int = 1) -> DataFrame:
    """Displaced particles ``ptype, id, x, y, z, vx, vy, vz, mass`` of cells ``id, x, y, z, size``.

    Types run from 1 by growing size. With baryons (``ob``), cells of the finest size also give gas of
    type 0: the pair is half a cell apart along z, and its centre of mass stays.
    """
    if not fills_box(points, box):
        raise ValueError("the cells do not fill the box")
    d = gather_displacement(lattice, points, n, box, boost_lattice, boost_n, repeat)
    vel = velocity_factor(a, h0, om, ol) * a**0.5 / h
    sizes = [r["size"] for r in size_classes(points).orderBy("size").collect()]
    kind = F.lit(1)
    for t, s in enumerate(sizes[1:5], 2):
        kind = F.when(F.col("size") >= s, t).otherwise(kind)
    finest = F.col("size") == sizes[0]
    moved = points.join(d, "id").select("id", "size", kind.alias("ptype"), *[F.col(c) for c in "xyz"], "vx", "vy", "vz")
    unit = particle_mass(1.0, 1.0, h0, h)
    mass = lambda frac: F.col("size") * F.col("size") * F.col("size") * (unit * frac)

    def rows(df, ptype, dz, frac):
        pos = {c: wrap(F.col(c) + F.col(f"v{c}") + (dz if c == "z" else F.lit(0.0)), box) for c in "xyz"}
        return df.select(ptype.cast("int").alias("ptype"), "id", *[pos[c].alias(c) for c in "xyz"], *[(F.col(f"v{c}") * vel).cast("double").alias(f"v{c}") for c in "xyz"], mass(frac).alias("mass"))

    if not ob:
        return rows(moved, F.col("ptype"), F.lit(0.0), om)
    half = F.col("size") * 0.5
    share = ob / om
    dm = rows(moved.where(finest), F.col("ptype"), half * share, om - ob)
    gas = rows(moved.where(finest), F.lit(0), half * (share - 1), ob)
    return dm.unionByName(gas).unionByName(rows(moved.where(~finest), F.col("ptype"), F.lit(0.0), om))


def measure(particles: DataFrame, n: int, box: float) -> DataFrame:
    """Binned spectrum of particles in a box, by mass."""
    unit = particles.select(*[wrap(F.col(c) / box).alias(c) for c in "xyz"], F.col("mass").alias("w"))
    mean = unit.agg(F.avg("w")).first()[0] or 1.0
    return spectrum(density_modes(deposit(unit.withColumn("w", F.col("w") / mean), n), n), n, box)


def measure_snapshot(spark: SparkSession, path: str, n: int, box: float, out: str | None = None, ddof: int = 1) -> DataFrame:
    """Spectrum of a snapshot directory, written as text if asked."""
    s = measure(read_gadget(spark, path), n, box)
    if out:
        write_spectrum(s, out)
    return s
