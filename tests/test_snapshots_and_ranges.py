"""Snapshots in both formats, their commit, forces in three ranges, and zooms around ellipsoids."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orrery.functions import kernels, shape
from orrery.operators import gravity, tree
from orrery.sources import particle_files, snapshots


def particles(spark, n=500, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(int(rng.choice([0, 1, 4])), 7 * k, *map(float, rng.random(6)), float(1 + k % 5)) for k in range(n)]
    return spark.createDataFrame(rows, snapshots.SCHEMA)


def in_order(df):
    got = df.toPandas().sort_values(["ptype", "id"]).reset_index(drop=True)
    return got.assign(id=np.arange(1, len(got) + 1))


@pytest.mark.parametrize(("labels", "double", "files"), [(True, True, 3), (False, False, 1), (True, False, 7)])
def test_round_trip_by_ranges(spark, tmp_path, labels, double, files):
    path, df = str(tmp_path / "snap"), particles(spark)
    snapshots.write_gadget(df, path, 0.5, 1.0, 0.3, 0.7, files=files, double=double, masses=[0, 2.5, 0, 0, 0, 0], to_kpc=False, labels=labels)
    assert sorted(os.listdir(path)) == [f"snapshot.{k}" for k in range(files)]
    want = in_order(df)
    want.loc[want.ptype == 1, "mass"] = 2.5
    for rows in (17, 1 << 20):
        read = snapshots.read_gadget(spark, path, rows=rows)
        assert read.rdd.getNumPartitions() >= (500 // 17 if rows == 17 else files)
        got = read.toPandas().sort_values("id").reset_index(drop=True)
        assert got["id"].tolist() == want["id"].tolist() and got["ptype"].tolist() == want["ptype"].tolist()
        assert np.allclose(got[["x", "y", "z", "vx", "vy", "vz", "mass"]], want[["x", "y", "z", "vx", "vy", "vz", "mass"]], rtol=0 if double else 1e-6, atol=0 if double else 1e-7)
    few = snapshots.read_gadget(spark, path, ["mass", "vy"], rows=100)
    assert few.columns == ["mass", "vy"] and abs(few.agg(F.sum("mass")).first()[0] - want["mass"].sum()) < 1e-3


def test_asked_columns_alone_are_read(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "snap")
    snapshots.write_gadget(particles(spark), path, 0.5, 1.0, 0.3, 0.7, files=1, labels=True, to_kpc=False)
    r = snapshots._Reader({"path": path, "rows": "100"}, ["id"])
    read = []
    plain = np.frombuffer
    monkeypatch.setattr(snapshots.np, "frombuffer", lambda b, *a: read.append(len(b)) or plain(b, *a))
    parts = r.partitions()
    assert len(parts) == 5 and [b.num_rows for p in parts for b in r.read(p)] == [100] * 5
    assert sum(read) == 4 * 500


def test_counts_in_place_of_a_header(spark, tmp_path):
    path = str(tmp_path / "snap")
    snapshots.write_gadget(particles(spark).withColumn("ptype", F.lit(1)), path, 0.5, 1.0, 0.3, 0.7, files=1)
    with open(f"{path}/snapshot.0", "r+b") as f:
        f.seek(8)
        f.write((0).to_bytes(4, "little") + (3).to_bytes(4, "little"))
    with pytest.raises(Exception, match="give counts"):
        snapshots.read_gadget(spark, path).count()
    assert snapshots.read_gadget(spark, path, ["ptype", "id"], counts=[0, 200, 300, 0, 0, 0]).groupBy("ptype").count().orderBy("ptype").collect() == [(1, 200), (2, 300)]


def batches(n, start=0):
    col = {"ptype": np.zeros(n, np.int32), "id": np.arange(n) + start, **{c: np.full(n, 0.5) for c in ("x", "y", "z", "vx", "vy", "vz", "mass")}, "file": np.zeros(n, np.int32)}
    return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in col.items()})


def test_failed_and_repeated_attempts(tmp_path):
    """A task that dies half way, one that runs twice, and a job that loses rows."""
    path = str(tmp_path / "snap")
    options = {"path": path, "totals": "100,0,0,0,0,0", "masses": "0,0,0,0,0,0", "files": "1"}

    def dies():
        yield batches(50)
        raise OSError("lost")

    w = snapshots._Writer(options, False)
    with pytest.raises(OSError, match="lost"):
        w.write(dies())
    w.write(iter([batches(50), batches(50, 50)]))
    once = w.write(iter([batches(50), batches(50, 50)]))
    assert not [x for x in os.listdir(path) if x.startswith("snapshot")]
    w.commit([once, None, snapshots.Written([])])
    assert os.listdir(path) == ["snapshot.0"]
    with snapshots._fs(path)[0].open_input_file(f"{path}/snapshot.0") as f:
        assert snapshots.directory(f) == {"HEAD": (4, 256), "POS ": (268, 1200), "VEL ": (1476, 1200), "ID  ": (2684, 400), "MASS": (3092, 400)}
    with pytest.raises(FileExistsError):
        snapshots._Writer(options, False)
    again = snapshots._Writer(options, True)
    with pytest.raises(ValueError, match="tasks wrote"):
        again.commit([again.write(iter([batches(50)]))])
    assert os.listdir(path) == ["snapshot.0"] and os.path.getsize(f"{path}/snapshot.0") == 264 + 100 * 32 + 4 * 8
    last = snapshots._Writer(options, True)
    last.write(iter([batches(100)]))
    last.abort([])
    assert os.listdir(path) == ["snapshot.0"]


def test_particle_tables(spark, tmp_path):
    df = particles(spark, 40)
    particle_files.save_particles(df, str(tmp_path / "p"))
    assert sorted(map(tuple, particle_files.load_particles(spark, str(tmp_path / "p")).collect())) == sorted(map(tuple, df.collect()))


def test_three_ranges_add_up(spark):
    """Points in all zones: the three ranges give the force of two."""
    rng = np.random.default_rng(12)
    xyz = np.concatenate([0.5 + 0.03 * rng.normal(size=(60, 3)), rng.random((60, 3)), 0.5 + 0.09 * rng.normal(size=(60, 3))]) % 1
    p = spark.createDataFrame([(k, *map(float, v), float(1 + k % 3)) for k, v in enumerate(xyz)], "id long, x double, y double, z double, w double")
    m = gravity.MediumRange((0.5, 0.5, 0.5), 0.03, 0.12, n=48)
    zones = m.zones(p).toPandas().sort_values("id")
    assert zones["inside"].sum() > 40 and zones["outside"].sum() > 40 and (zones["inside_ghost"] & zones["outside"]).sum() > 5
    vec = lambda df: df.toPandas().sort_values("id")[["ax", "ay", "az"]].to_numpy()
    got = vec(m.accel(p, 300))
    want = vec(gravity.total_accel(p, kernels.ForceSplit("cubic", 0.12), 300))
    for own in (zones["inside"].to_numpy(), zones["outside"].to_numpy()):
        assert np.linalg.norm((got - want)[own]) / np.linalg.norm(want[own]) < 0.02


def test_ranges_that_do_not_fit():
    with pytest.raises(ValueError, match="fine radius"):
        gravity.MediumRange((0.5, 0.5, 0.5), 0.1, 0.1, n=16)
    with pytest.raises(ValueError, match="does not fit"):
        gravity.MediumRange((0.5, 0.5, 0.5), 0.3, 0.1)


@pytest.mark.parametrize("mode", ["cubic", "quartic", "erf"])
@pytest.mark.parametrize("deconvolve", [False, True])
def test_factors_are_the_weights(spark, mode, deconvolve):
    split = kernels.ForceSplit(mode, 0.15, n=8, deconvolve=deconvolve)
    w = split.weights()
    rows = spark.createDataFrame([(a, b, c, a * a + b * b + c * c) for a in range(5) for b in range(5) for c in range(5)], "a int, b int, c int, m2 long")
    for r in rows.withColumn("f", split.factor()(F.col("m2"))).collect():
        assert np.isclose(r["f"], w[r["a"], r["b"], r["c"]], rtol=1e-10, atol=1e-9)


def plain_leaves(a, k, centre, theta, n):
    """Leaves of the refinement by a loop over cells: depth and lower corner."""
    def least(x0, w):
        x1 = x0 + w
        if x0 < 0 < x1:
            return 0.0
        near = [v + s for v in (x0, x1) for s in (-1, 0, 1)]
        return min(near, key=abs)

    out, todo = [], [(0, 0, 0, 0)]
    while todo:
        d, *at = todo.pop()
        w = 0.5**d
        v = np.array([least(c * w - o, w) for c, o in zip(at, centre, strict=True)])
        if d < n and (v @ a @ v - k) * float(np.float32(theta)) ** 2 < w * w:
            todo += [(d + 1, *(2 * c + (q >> b & 1) for c, b in zip(at, (2, 1, 0), strict=True))) for q in range(8)]
        else:
            out.append((d, *at))
    return out


def test_ellipsoid_zoom(spark):
    r = np.linalg.qr(np.random.default_rng(3).normal(size=(3, 3)))[0]
    a = r @ np.diag([1 / 0.05**2, 1 / 0.1**2, 1 / 0.08**2]) @ r.T
    top = np.linalg.eigvalsh(a)[-1]
    centre = (0.45, 0.5, 0.55)
    leaves = tree.refine(spark, tree.ellipsoid_test(a / top, centre, 0.8, 1 / top), 5)
    assert sorted(tuple(x) for x in leaves.select("depth", "i", "j", "k").collect()) == sorted(plain_leaves(a / top, 1 / top, centre, 0.8, 5))
    box = 20.0
    cells = tree.zoom_ellipsoid(spark, box, 32, tuple(box * c for c in centre), a / box**2, 0.8).toPandas()
    assert abs((cells["size"] ** 3).sum() - box**3) < 1e-6 * box**3 and set(cells["depth"]) <= set(tree.zoom_levels(5))
    with pytest.raises(ValueError, match="positive"):
        tree.zoom_ellipsoid(spark, box, 32, centre, -a)


def test_zoom_around_points(spark):
    rng = np.random.default_rng(4)
    xyz = 0.5 + rng.normal(size=(80, 3)) * [0.03, 0.02, 0.01]
    p = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(xyz)], "id long, x double, y double, z double")
    cells = tree.zoom_around(p, 32, 0.6).toPandas()
    a, c = shape.bounding_ellipsoid(p)
    inside = ((cells[["x", "y", "z"]].to_numpy() - c) @ a * (cells[["x", "y", "z"]].to_numpy() - c)).sum(1) < 1
    assert inside.any() and (cells["size"][inside] == 1 / 32).all()
    finest = cells["size"] == 1 / 32
    for v in xyz:  # every point lies in a finest cell
        assert (np.abs(cells[["x", "y", "z"]].to_numpy() - v).max(1) <= 1 / 64 + 1e-12)[finest].any()
