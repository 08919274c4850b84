"""Operators against known values and NumPy."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrery.functions import cosmology, kernels, shape
from orrery.operators import cells, domains, fourier, graph, gravity, lattice, lookup, neighbours, tree
from orrery.plans import initial_conditions as ics
from orrery.sources import particle_files, snapshots, views
from orrery.streaming import evolve


def points(spark, xyz, w=None, start=0):
    rows = [(i + start, *map(float, p), float(1 if w is None else w[i])) for i, p in enumerate(xyz)]
    return spark.createDataFrame(rows, "id long, x double, y double, z double, w double")


def vec(df, cols=("ax", "ay", "az")):
    return df.toPandas().sort_values("id")[list(cols)].to_numpy()


THREE = [(0.98, 0.98, 0.98), (0.98, 0.08, 0.98), (0.03, 0.03, 0.03)]
WANT = np.array([[230.94010768, 430.94010768, 230.94010768], [230.94010768, -330.94010768, 230.94010768], [-230.94010768, 76.98003589, -230.94010768]])


def test_three_bodies_periodic(spark):
    p = points(spark, THREE, [1, 2, 3])
    got = vec(gravity.kernel_sum(p, 0.12, kernels.newton(0.12, 400)))
    assert np.abs(got - WANT).max() / np.abs(WANT).max() < 1e-3
    assert np.allclose(vec(gravity.direct_sum(p)), WANT, rtol=1e-6)
    assert cells.count_pairs(p, 0.12).first()[0] == 3


def test_cloud_in_cell(spark):
    p = points(spark, [(1.2, 0.6, 2.5), (0.5, 0.4, 0.3)], [0.1, 0.5])
    got = {r["cell"]: r["mass_fx"] / 1e9 for r in lattice.deposit(p, 3, scale=1.0).collect()}
    want = {0: 0.105, 1: 0.045, 3: 0.07, 4: 0.03, 9: 0.121, 10: 0.045, 11: 0.016, 12: 0.094, 13: 0.03, 14: 0.024, 18: 0.004, 20: 0.004, 21: 0.006, 23: 0.006}
    assert all(abs(got.get(k, 0) - v) < 1e-8 for k, v in want.items())
    assert abs(sum(got.values()) - 0.6) < 1e-7


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(*[st.floats(0, 0.999)] * 3), min_size=1, max_size=20), st.integers(2, 7))
def test_deposit_keeps_mass(spark, xyz, n):
    total = lattice.deposit(points(spark, xyz), n).agg(F.sum("mass_fx")).first()[0]
    assert abs(total / 1e9 - len(xyz)) < 1e-6


def test_deposit_rate_is_the_difference_of_moved_points(spark):
    p = points(spark, [(1.2, 0.6, 2.5), (0.5, 0.4, 0.3)], [0.1, 0.5])
    v = p.withColumns({"vx": F.when(F.col("id") == 0, 0.1).otherwise(0.0), "vy": F.lit(0.0), "vz": F.when(F.col("id") == 1, -0.2).otherwise(0.0)})
    rate = {r["cell"]: r["rate_fx"] for r in lattice.deposit_rate(v, 3, scale=1.0).collect()}
    a = {r["cell"]: r["mass_fx"] for r in lattice.deposit(p, 3, scale=1.0).collect()}
    moved = v.withColumns({c: F.col(c) + F.col(f"v{c}") for c in "xyz"})
    b = {r["cell"]: r["mass_fx"] for r in lattice.deposit(moved, 3, scale=1.0).collect()}
    assert all(abs(a.get(k, 0) + rate.get(k, 0) - b.get(k, 0)) < 10 for k in set(a) | set(b) | set(rate))


def test_gradient_and_gather(spark):
    n = 5
    v = np.random.RandomState(1).randint(-9, 9, (n, n, n))
    df = spark.createDataFrame(pd.DataFrame({"cell": np.arange(n**3), "v": v.ravel()}))
    got = lattice.gradient12(df, n).toPandas().sort_values("cell")
    for a, c in enumerate("xyz"):
        want = -np.roll(v, -2, a) + 8 * np.roll(v, -1, a) - 8 * np.roll(v, 1, a) + np.roll(v, 2, a)
        assert (got[f"g{c}"].to_numpy() == want.ravel()).all()
    two = spark.createDataFrame(pd.DataFrame({"cell": np.arange(8), "v": np.arange(8)}))
    assert lattice.gradient12(two, 2).agg(F.max(F.abs("gx"))).first()[0] == 0
    p = np.random.RandomState(2).rand(6, 3)
    got = lattice.gather(df, points(spark, p), n, ["v"]).toPandas().sort_values("id")["v"].to_numpy()
    q = p * n
    i = np.floor(q).astype(int)
    f = q - i
    want = sum(np.prod([f[:, a] if s[a] else 1 - f[:, a] for a in range(3)], 0) * v[(i[:, 0] + s[0]) % n, (i[:, 1] + s[1]) % n, (i[:, 2] + s[2]) % n] for s in np.ndindex(2, 2, 2))
    assert np.allclose(got, want)


def test_friends_of_friends(spark):
    p = points(spark, [(0.5, 0.2, 0.2), (0.95, 0.5, 0.4), (0.95, 0.4, 0.5), (0.95, 0.5, 0.6), (0.05, 0.5, 0.5)])
    g = {r["id"]: r["grp"] for r in graph.friends_of_friends(p, 0.2).collect()}
    assert g == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1}
    assert graph.components(p.select("id"), spark.createDataFrame([], "src long, dst long")).where("id = label").count() == 5


def test_ghost_masks(spark):
    xyz = [(0.17, 0.17, 0.17), (0.17, 0.17, 0.3), (0.17, 0.17, 0.05), (0.17, 0.17, 0.5), (0.17, 0.3, 0.17), (0.5, 0.5, 0.5), (0.29, 0.29, 0.29)]
    bits = lattice.full(spark, 3).select("cell", F.expr("shiftleft(cast(1 as bigint), cast(cell as int))").alias("bits"))
    got = [r["mask"] for r in domains.ghost_masks(points(spark, xyz), bits, 3, 0.07).orderBy("id").collect()]
    assert got == [1, 3, 5, 2, 9, 8192, 5659]
    with pytest.raises(ValueError):
        domains.ghost_masks(points(spark, xyz), bits, 3, 0.5)


def test_region_growing():
    w = np.array([[[4, 0], [0, 3]], [[2, 2], [1, 1]]]).ravel()
    assert domains._grow(w, 2, 3).reshape(2, 2, 2).tolist() == [[[1, 4], [4, 2]], [[3, 3], [4, 4]]]


def test_subcube(spark):
    p = points(spark, [(0.4, 0.3, 0.2), (0.4, 0.3, 0.34), (0.9, 0.8, 0.7)])
    got = [tuple(r)[1:] for r in cells.subcube_flags(p, (0.4, 0.3, 0.2), 0.15, 0.1).orderBy("id").collect()]
    assert got == [(True, True, False, False), (True, True, True, False), (False, False, True, True)]
    with pytest.raises(ValueError):
        cells.subcube_flags(p, (0.4, 0.3, 0.2), 0.5, 0.1)


def test_refinement_counts(spark):
    leaves = tree.refine(spark, tree.sphere_test((0.5, 0.4, 20.1 / 50), 1 / 50, 0.9), 7)
    forced = tree.force_levels(leaves, [3, 5, 6, 7])
    got = {r["depth"]: r["count"] for r in forced.groupBy("depth").count().collect()}
    assert got == {3: 476, 5: 2244, 6: 358, 7: 976}
    assert sum(n * 8.0**-d for d, n in got.items()) == 1.0
    assert tree.forced_node_count(leaves, [3, 5, 6, 7]) * 7 + 1 == forced.count()
    with pytest.raises(MemoryError):
        tree.refine(spark, tree.sphere_test((0.5, 0.4, 0.402), 0.02, 0.9), 7, max_cells=100)


def test_octree(spark):
    p = points(spark, np.random.RandomState(3).rand(200, 3))
    t = tree.octree(p, 8, 5).toPandas()
    assert t[t.leaf].n.sum() == 200 and (t[t.leaf & (t.depth < 8)].n <= 5).all()
    assert t[t.depth == 0].n.tolist() == [200]


def test_transforms(spark):
    n = 6
    z = np.random.RandomState(6).rand(n, n, n) + 1j * np.random.RandomState(7).rand(n, n, n)
    df = spark.createDataFrame(pd.DataFrame({"cell": np.arange(n**3), "re": z.real.ravel(), "im": z.imag.ravel()}))
    got = fourier.fft(df, n).toPandas().sort_values("cell")
    assert np.allclose(got.re.to_numpy() + 1j * got.im.to_numpy(), np.fft.fftn(z).ravel())
    back = fourier.fft(fourier.fft(df, n), n, inverse=True).toPandas().sort_values("cell")
    assert np.allclose(back.re.to_numpy(), z.real.ravel())


def test_spectrum_matches_numpy(spark):
    n, box = 8, 50.0
    xyz = np.random.RandomState(8).rand(300, 3)
    s = fourier.spectrum(fourier.density_modes(lattice.deposit(points(spark, xyz), n), n), n, box).toPandas().sort_values("bin")
    grid = np.zeros((n, n, n))
    q = xyz * n
    i = np.floor(q).astype(int)
    f = q - i
    for c in np.ndindex(2, 2, 2):
        np.add.at(grid, tuple((i + c).T % n), np.prod([f[:, a] if c[a] else 1 - f[:, a] for a in range(3)], 0))
    m = np.fft.ifftn(grid / grid.mean() - 1)
    k = np.fft.fftfreq(n, 1 / n)
    n2 = (k[:, None, None] ** 2 + k[None, :, None] ** 2 + k[None, None, :] ** 2).round().astype(int)
    u = n2 * (np.pi / n) ** 2
    pw = np.abs(m * (1 + u / 3 + u * u / 15)) ** 2
    b = np.clip(np.digitize(np.sqrt(n2), np.arange(n // 2 - 1) + 1.5), 0, n // 2 - 1)
    dk = 2 * np.pi / box
    want = np.bincount(b.ravel(), pw.ravel()) / (np.bincount(b.ravel()) * dk**3)
    assert np.allclose(s.p.to_numpy(), want, rtol=1e-5)
    assert fourier.bin_counts(spark, n).agg(F.sum("n_modes")).first()[0] == n**3


def test_wave_number_functions(spark):
    for n in (6, 7):
        f = lambda k: (np.cos(k) - np.sin(k) / k) / (4 * np.pi)
        got = fourier.on_modes(spark, n, 100.0, f, numpy=True).toPandas().sort_values("cell")["f"].to_numpy()
        k1 = np.arange(n)
        k1 = np.where(k1 <= n // 2, k1, k1 - n) * 2 * np.pi / 100
        k = np.sqrt(k1[:, None, None] ** 2 + k1[None, :, None] ** 2 + k1[None, None, :] ** 2).ravel()
        want = np.r_[0.0, f(k[1:])]
        assert np.allclose(got, want, atol=1e-13)


def test_force_split_tables():
    for mode in ("cubic", "quartic"):
        t = kernels.split_table(mode, 0.1, 50)
        assert abs(t[-1]) < 1e-6 * abs(t[0])
    soft = kernels.split_table("erf", 0.1, 50, r_soft=0.002)
    assert abs(soft[-1]) < 0.03 * 1000
    for mode in ("cubic", "quartic", "erf"):
        assert np.allclose(kernels.transfer(mode, np.array([0.0])), 1)
        a = np.array([0.0099, 0.0101])
        assert abs(np.diff(kernels.transfer(mode, a)))[0] < 1e-4
    assert kernels.fft_size(0.105) == 64
    with pytest.raises(ValueError):
        kernels.fft_size(0.2)
    with pytest.raises(ValueError):
        kernels.ForceSplit("none")


def test_periodic_helpers(spark):
    p = points(spark, [(0.05, 0.5, 0.99), (0.5, 0.5, 0.5)])
    assert {(r["sx"], r["sy"], r["sz"]) for r in cells.pad_periodic(p, 0.1).collect()} == {(1, 0, 0), (0, 0, -1), (1, 0, -1)}
    with pytest.raises(ValueError):
        cells.pad_periodic(p, 0.5)
    with pytest.raises(ValueError):
        cells.sides(0.5)
    with pytest.raises(ValueError):
        cells.check_unit(points(spark, [(1.0, 0, 0)]))
    for r in (0.2, 0.4, 0.49):
        xyz = np.random.RandomState(9).rand(40, 3)
        d = xyz[:, None] - xyz[None]
        d -= np.floor(d + 0.5)
        assert cells.count_pairs(points(spark, xyz), r).first()[0] == int(((d**2).sum(-1) < r * r).sum() - 40) // 2


def test_nearest(spark):
    xyz = np.random.RandomState(10).rand(30, 3)
    got = neighbours.nearest(points(spark, xyz), 4).toPandas().sort_values(["i", "rank"])
    d = xyz[:, None] - xyz[None]
    d -= np.floor(d + 0.5)
    r2 = (d**2).sum(-1)
    np.fill_diagonal(r2, 9)
    assert got["j"].tolist() == np.argsort(r2, 1)[:, :4].ravel().tolist()


def test_cosmology():
    assert abs(cosmology.growth(1 / 51, 0.279, 0.721) - 0.0256010117) < 1e-8
    assert abs(cosmology.tophat_variance(cosmology.efstathiou(), 8.0) - 8.277036e-5) < 1e-7
    p = cosmology.normalised(cosmology.efstathiou(), 0.8, 1.0, 0.3, 0.7)
    assert abs(cosmology.tophat_variance(p, 8.0) - 0.64) < 1e-9
    k = np.logspace(-3, 1, 30)
    t = cosmology.tabulated(k, cosmology.efstathiou()(k))
    assert np.allclose(t(k), cosmology.efstathiou()(k))
    a = 0.5
    slope = (math.log(cosmology.growth(a * 1.001, 0.3, 0.7)) - math.log(cosmology.growth(a * 0.999, 0.3, 0.7))) / 0.002
    assert abs(slope * cosmology.hubble(a, 1.0, 0.3, 0.7) / cosmology.velocity_factor(a, 1.0, 0.3, 0.7) - 1) < 0.03


def test_two_bodies_meet(spark):
    p = points(spark, [(0.45, 0.5, 0.5), (0.55, 0.5, 0.5)], [1e-3, 1e-3]).withColumns({f"v{c}": F.lit(0.0) for c in "xyz"})
    m = evolve.GravityModel(p, kernels.ForceSplit("cubic", 0.17, n=36), 0.01)
    out = list(evolve.integrate(m, [0.2], most=0.1))
    x = out[-1][1].orderBy("id").toPandas().x.to_numpy()
    assert out[-1][0] == 0.2 and 0.45 < x[0] < x[1] < 0.55 and abs(x.sum() - 1) < 1e-6
    assert evolve.limit([("a", 1.0), ("b", 1.0)]) == ("a", 1.0)


def test_ellipsoid(spark):
    xyz = np.random.RandomState(11).rand(200, 3) * 0.4
    a, c = shape.bounding_ellipsoid(points(spark, xyz))
    assert np.einsum("ni,ij,nj->n", xyz - c, a, xyz - c).max() <= 1 + 1e-9


def test_snapshot_round_trip(spark, tmp_path):
    rows = [(t, i, *np.random.RandomState(i).rand(6).tolist(), 1e10 * (i + 1)) for i, t in enumerate([1] * 7 + [2] * 4)]
    df = spark.createDataFrame(rows, particle_files.SCHEMA)
    snapshots.write_gadget(df, str(tmp_path / "snap"), 0.5, 100.0, 0.3, 0.7, files=2, double=True)
    got = snapshots.read_gadget(spark, str(tmp_path / "snap")).toPandas().sort_values("id")
    assert got["id"].tolist() == list(range(1, 12)) and len(list((tmp_path / "snap").iterdir())) == 2
    assert np.allclose(got[["x", "y", "z"]].to_numpy(), np.array([r[2:5] for r in rows]) * 1e3)
    assert np.allclose(got["mass"].to_numpy(), np.arange(1, 12))
    assert particle_files.split_counts([10, 0, 3, 0, 0, 0], 3)[2][0] == (8, 10)


def test_text_and_cube_sources(spark, tmp_path):
    s = spark.createDataFrame([(0, 0.0, 1.0, 2.0, 3.0, None), (1, 1.0, 2.0, 2.0, 4.0, 0.5)], "bin long, kmin double, kmax double, kvol double, p double, err double")
    particle_files.write_spectrum(s, str(tmp_path / "s"), ["made up"])
    assert particle_files.read_spectrum(spark, str(tmp_path / "s")).count() == 2
    np.save(tmp_path / "c.npy", np.arange(27).reshape(3, 3, 3))
    assert particle_files.read_cube(spark, str(tmp_path / "c.npy")).where("v = cell").count() == 27


def test_mass_field(spark):
    u = views.lattice_points(spark, 4, 10.0)
    still = spark.range(64).select(F.col("id").alias("cell"), *[F.lit(0.0).alias(f"v{c}") for c in "xyz"])
    out = ics.mass_field(u, still, 4, 10.0, 0.02, 100.0, 0.3, 0.7, ob=0.05).toPandas()
    assert sorted(out.ptype.unique()) == [0, 1] and len(out) == 128
    pair = out.merge(out, on="id", suffixes=("_g", "_d"))
    pair = pair[(pair.ptype_g == 0) & (pair.ptype_d == 1)]
    dz = (pair.z_d - pair.z_g) % 10
    assert np.allclose(dz, 1.25) and abs(out.mass.sum() / cosmology.particle_mass(10.0, 0.3) - 1) < 1e-9
    assert ics.fills_box(u, 10.0)


def test_levels_are_written_once(spark, tmp_path):
    lat = spark.range(8**3).select(F.col("id").alias("cell"), F.col("id").alias("v"))
    assert lattice.save_levels(lat, 8, str(tmp_path / "l"), least=2) == [8, 4, 2]
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        lattice.save_levels(lat, 8, str(tmp_path / "l"), least=2)


# --- against an independent lattice sum, and at the tolerances that forces are used with

#: Ewald forces of three and of two bodies.
CLOSE = ([(0.5, 0.5, 0.5), (0.5, 0.6, 0.5), (0.9, 0.3, 0.95)], [1, 2, 3], [[2.04840161, 196.8858954, 1.18571601], [1.63087151, -101.75612334, 0.92870922], [-1.77004821, 2.20878376, -1.01437815]])
APART = ([(0.2, 0.2, 0.2), (0.7, 0.6, 0.5)], [1, 10], [[0.0, 5.26024612, 7.09533177], [0.0, -0.526024612, -0.709533177]])


@pytest.mark.parametrize("case", [CLOSE, APART])
def test_ewald_sum(spark, case):
    xyz, w, want = case
    assert np.allclose(vec(gravity.ewald_sum(points(spark, xyz, w))), want, atol=1e-5)


@pytest.mark.parametrize("mode", ["erf", "cubic"])
def test_short_and_long_range_equal_a_lattice_sum(spark, mode):
    xyz, w, want = CLOSE
    got = vec(gravity.total_accel(points(spark, xyz, w), kernels.ForceSplit(mode, 0.105)))
    assert np.abs(got - want).max() / np.sqrt((np.array(want) ** 2).sum(1).max()) < 1.5e-2


def test_long_range_equals_a_lattice_sum(spark):
    xyz, w, want = APART
    got = vec(gravity.mesh_accel(points(spark, xyz, w), kernels.ForceSplit("erf", 0.15)))
    assert np.abs(got - want).max() / np.sqrt((np.array(want) ** 2).sum(1).max()) < 2e-3


def all_pairs(xyz, w, rmax, table, periodic):
    d = xyz[:, None] - xyz[None]
    if periodic:
        d -= np.floor(d + 0.5)
    r = np.sqrt((d**2).sum(-1))
    k = np.interp(r, rmax * np.arange(len(table) + 1) / len(table), np.r_[0, table]) * (r < rmax)
    return (d * (k * w[None])[:, :, None]).sum(1)


def clumps(seed, sizes, width):
    """Gaussian clumps of given sizes at random centres, with weights of their own, inside the unit cube."""
    rng = np.random.default_rng(seed)
    centre = rng.uniform(0.3, 0.7, (len(sizes), 3))
    xyz = np.concatenate([c + width * rng.normal(size=(n, 3)) for c, n in zip(centre, sizes, strict=True)])
    return np.clip(xyz, 0.001, 0.999), rng.uniform(0.5, 2.0, sum(sizes))


def lost(got, want):
    """What of the forces is lost: the norm of all differences over that of all forces."""
    return np.linalg.norm(got - want) / np.linalg.norm(want)


@pytest.mark.parametrize(("theta", "most"), [(0.0, 1e-12), (0.7, 0.05)])
def test_tree_sums_lose_little(spark, theta, most):
    xyz, w = clumps(2024, (90, 60, 30), 0.05)
    table = kernels.newton(0.9, 300)
    want = all_pairs(xyz, w, 0.9, table, False)
    assert lost(vec(gravity.tree_sum(points(spark, xyz, w), 0.9, table, theta=theta, bucket=6, depth=7)), want) < most


@pytest.mark.parametrize(("shift", "stretch"), [(0.0, 1.0), (-0.5, 2.0)])
def test_no_node_on_the_cutoff_is_taken_whole(spark, shift, stretch):
    """Far nodes that the cutoff passes through are opened, for points in the unit cube and beyond: no point's force is off by much."""
    xyz = np.clip(0.5 + 0.0625 * np.random.default_rng(5).normal(size=(2500, 3)), 0.001, 0.999)
    xyz[0] = 0.5, 0.5, 0.67
    w = 1.0 + np.arange(2500) % 7
    xyz = (xyz + shift) * stretch
    table = kernels.newton(0.2 * stretch)
    want = all_pairs(xyz, w, 0.2 * stretch, table, False)
    got = vec(gravity.tree_sum(points(spark, xyz, w), 0.2 * stretch, table, theta=0.5, depth=6))
    off = np.sqrt(((got - want) ** 2).sum(1) / (want**2).sum(1).mean())
    assert off.max() < 0.02


@pytest.mark.parametrize("reach", [2, 3])
def test_monopole_sums_lose_little(spark, reach):
    xyz, w = clumps(77, (400, 200), 0.04)
    table = kernels.newton(0.15, 500)
    want = all_pairs(xyz, w, 0.15, table, True)
    assert lost(vec(gravity.monopole_sum(points(spark, xyz, w), 0.15, table, reach)), want) < 0.015


def test_sums_by_the_number_of_neighbours(spark):
    """Few neighbours one by one, many by cells; counted where no number is given."""
    xyz, w = clumps(5, (500,), 0.03)
    table = kernels.newton(0.15, 300)
    want = all_pairs(xyz, w, 0.15, table, True)
    p = points(spark, xyz, w)
    few, mid, many, own = (vec(gravity.kernel_sum_for(p, 0.15, table, n)) for n in (140, 141, 401, None))
    assert lost(few, want) < 1e-12 < lost(mid, want) < 0.015 and lost(many, want) < 0.015
    assert np.array_equal(own, mid) or np.array_equal(own, many) or min(lost(own, mid), lost(own, many)) < 1e-12
    thin = points(spark, np.random.default_rng(1).random((60, 3)))
    assert np.allclose(vec(gravity.kernel_sum_for(thin, 0.1, table)), vec(gravity.kernel_sum(thin, 0.1, table)), rtol=1e-12)


@pytest.mark.parametrize("cut", [0, 2])
def test_displacement_equals_numpy(spark, cut):
    n, box, p = 12, 50.0, cosmology.efstathiou()
    got = fourier.displacement(spark, p, n, box, 9, cut_below=cut).orderBy("cell").toPandas()
    g = np.random.RandomState(9).standard_normal(2 * n**3).reshape(n, n, n, 2)
    k = np.fft.fftfreq(n, 1 / n)
    n2 = k[:, None, None] ** 2 + k[None, :, None] ** 2 + k[None, None, :] ** 2
    kk = np.where(n2 > 0, np.sqrt(n2), 1) * 2 * np.pi / box
    f = np.where((n2 > 0) & (n2 >= cut * cut), np.sqrt(p(kk) * (2 * np.pi / box) ** 3) / kk**2, 0)
    psi = np.fft.fftn(f * (g[..., 0] + 1j * g[..., 1])).real * n / box
    for axis, name in enumerate("xyz"):
        r = lambda s: np.roll(psi, -s, axis)  # noqa: B023, E731
        want = (-r(2) + 8 * r(1) - 8 * r(-1) + r(-2)) / 12
        assert np.allclose(got[f"v{name}"], want.ravel(), rtol=1e-5, atol=1e-6 * np.abs(want).max())


def test_ellipsoid_is_the_smallest(spark):
    """Against the fit to every point: thin clouds, whose support lies between fixed directions."""
    rng = np.random.RandomState(3)
    xyz = rng.randn(3000, 3) * [0.2, 0.01, 0.05] @ np.linalg.qr(rng.randn(3, 3))[0] + 0.5
    a, c = shape.bounding_ellipsoid(points(spark, xyz))
    inside = np.einsum("ni,ij,nj->n", xyz - c, a, xyz - c)
    b, _ = shape.khachiyan(xyz, 1e-4)
    assert inside.max() <= 1 + 1e-9 and abs(np.sqrt(np.linalg.det(b) / np.linalg.det(a)) - 1) < 0.02


def test_interpolation_at_the_ends(spark):
    t = spark.createDataFrame([(1.0, 10.0), (2.0, 20.0), (4.0, 0.0), (2.0, 25.0), (None, 1.0)], "x double, y double")
    e = spark.createDataFrame([(i, v) for i, v in enumerate([0.5, 1.0, 1.5, 3.0, 4.0, None])], "id long, at double")
    assert [tuple(r) for r in lookup.interpolate(e, t, "at").orderBy("id").collect()] == [(1, 1.0, 10.0), (2, 1.5, 15.0), (3, 3.0, 10.0)]
