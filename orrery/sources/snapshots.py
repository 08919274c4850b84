"""GADGET-1 snapshots as a Spark data source: read by ranges of records, written in one commit.

A snapshot is any number of files. Each has records between length marks: a 256-byte header, then positions, velocities,
ids and (for types whose mass in the header is 0) masses, each for all particles in the order of types. Files of the
second format have a record of 8 bytes with a label ahead of each.

Reading: the driver reads the marks alone, a few bytes a record, and splits every file into ranges of particles. A task
reads the bytes of its range, and only of the columns asked for. Writing: a task streams Arrow batches of a file's
particles into a piece for each record, joins them to a file under a temporary name, and reports it; the commit renames what
the successful tasks have reported. Attempts that fail or are repeated leave nothing behind under a final name.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from orrery.sources.particle_files import SCHEMA, number_rows, split_counts

#: The header's layout (counts, masses, time and redshift, flags, totals, box and cosmology, high words of the
#: totals), the labels of records in their order, and what a length mark can hold.
_HEADER = struct.Struct("<6i6d2d2i6I2i4d2i6I")
LABELS = ("HEAD", "POS ", "VEL ", "ID  ", "MASS")
RECORD_LIMIT = (1 << 31) - 1
_PIECE = 8 << 20


def _fs(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def directory(f) -> dict[str, tuple[int, int]]:
    """Label to (offset, size) of every record of an open file; only marks and labels are read."""
    out: dict[str, tuple[int, int]] = {}
    at, size, label = 0, f.size(), None
    while at < size:
        f.seek(at)
        n = struct.unpack("<I", f.read(4))[0]
        if n == 8 and label is None:
            label = f.read(8)[:4].decode("ascii")
        else:
            out[label or LABELS[min(len(out), 4)]] = (at + 4, n)
            label = None
        if at + n + 8 > size:
            raise ValueError("a record passes the end of its file")
        at += n + 8
    return out


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int
    counts: tuple[int, ...]
    masses: tuple[float, ...]
    records: dict[str, tuple[int, int]] = field(default_factory=dict)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.path, self.names = options["path"], names
        self.rows = int(options.get("rows", 1 << 20))
        self.counts = tuple(map(int, options["counts"].split(","))) if options.get("counts") else None

    def partitions(self):
        from pyarrow import fs as pafs

        fs, base = _fs(self.path)
        if fs.get_file_info(base).type == pafs.FileType.Directory:
            files = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(base)) if f.is_file and not f.base_name.startswith((".", "_")))
        else:
            files = [base]
        out = []
        for path in files:
            with fs.open_input_file(path) as f:
                records = directory(f)
                at, n = records["HEAD"]
                f.seek(at)
                h = _HEADER.unpack_from(f.read(n))
            counts = self.counts or h[:6]
            total = sum(counts)
            if total and records["POS "][1] not in (12 * total, 24 * total):
                raise ValueError(f"{path}: positions are not those of {total} particles; give counts")
            out += [Range(path, s, min(total, s + self.rows), tuple(counts), tuple(h[6:12]), records) for s in range(0, total, self.rows)]
        return out

    def read(self, p: Range) -> Iterator:
        fs, _ = _fs(self.path)
        total, n = sum(p.counts), p.stop - p.start
        with fs.open_input_file(p.path) as f:

            def part(label, start, stop, width, kind):
                at, size = p.records[label]
                each = size // width
                f.seek(at + start * each)
                return np.frombuffer(f.read((stop - start) * each), f"<{kind}{each // (3 if kind == 'f' and width == total and label != 'MASS' else 1)}")

            held = {}
            for label, names in (("POS ", "x y z"), ("VEL ", "vx vy vz")):
                if {*names.split()} & {*self.names}:
                    v = part(label, p.start, p.stop, total, "f").reshape(n, 3).astype(float)
                    held |= dict(zip(names.split(), (np.ascontiguousarray(c) for c in v.T), strict=True))
            if "id" in self.names:
                held["id"] = part("ID  ", p.start, p.stop, total, "u").astype(np.int64)
            if {"ptype", "mass"} & {*self.names}:
                ends = np.cumsum(p.counts)
                kind = np.searchsorted(ends, np.arange(p.start, p.stop), "right")
                held["ptype"] = kind.astype(np.int32)
                own = np.array([c > 0 and m == 0 for c, m in zip(p.counts, p.masses, strict=True)])
                mass = np.array(p.masses)[kind]
                if "mass" in self.names and own[kind].any():
                    size = np.where(own, p.counts, 0)
                    first = int(np.clip(p.start - (ends - p.counts), 0, p.counts)[own].sum())
                    mass[own[kind]] = part("MASS", first, first + int(own[kind].sum()), int(size.sum()), "f")
                held["mass"] = mass
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(held[c]) for c in self.names], names=self.names)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str, tuple[int, ...]]]


class _Writer(DataSourceArrowWriter):
    """Takes rows in the order of (file, ptype, id)."""

    def __init__(self, options: dict, overwrite: bool):
        self.o, self.overwrite = options, overwrite
        self.job = uuid.uuid4().hex
        fs, base = _fs(options["path"])
        from pyarrow import fs as pafs

        if not overwrite and any(f.base_name.startswith("snapshot.") for f in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))):
            raise FileExistsError(f"{base} holds a snapshot")
        fs.create_dir(f"{base}/_temporary/{self.job}", recursive=True)

    def write(self, iterator) -> WriterCommitMessage:
        fs, base = _fs(self.o["path"])
        here = f"{base}/_temporary/{self.job}/{uuid.uuid4().hex}"  # of this attempt alone
        fs.create_dir(here, recursive=True)
        real = "<f8" if self.o.get("double") == "true" else "<f4"
        whole = "<u8" if sum(map(int, self.o["totals"].split(","))) >= 1 << 32 else "<u4"
        fixed = np.array([float(x) for x in self.o["masses"].split(",")])
        done: list[tuple[str, str, tuple[int, ...]]] = []
        number, counts, pieces = None, np.zeros(6, int), {}

        def finish():
            for p in pieces.values():
                p.close()
            names = [x for x in LABELS[1:] if x in pieces]
            sizes = {x: fs.get_file_info(f"{here}/{x.strip()}").size for x in names}
            if max(sizes.values()) > RECORD_LIMIT:
                raise ValueError("a record passes 2**31 - 1 bytes; write more files")
            temp = f"{here}/snapshot.{number}"
            with fs.open_output_stream(temp) as out:
                for x in ("HEAD", *names):
                    head = self._header(counts) if x == "HEAD" else b""
                    n = len(head) or sizes[x]
                    mark = struct.pack("<I", n)
                    if self.o.get("labels") == "true":
                        out.write(struct.pack("<I4sII", 8, x.encode(), n + 8, 8))
                    out.write(mark + head)
                    if not head:
                        with fs.open_input_stream(f"{here}/{x.strip()}") as f:
                            while block := f.read(_PIECE):
                                out.write(block)
                        fs.delete_file(f"{here}/{x.strip()}")
                    out.write(mark)
            done.append((temp, f"{base}/snapshot.{number}", tuple(map(int, counts))))

        for b in iterator:
            col = {c: b.column(c).to_numpy(zero_copy_only=False) for c in b.schema.names}
            cuts = [0, *(np.flatnonzero(np.diff(col["file"])) + 1), b.num_rows]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if s == e:
                    continue
                if number != col["file"][s]:
                    if number is not None:
                        finish()
                    number, counts, pieces = int(col["file"][s]), np.zeros(6, int), {}
                kind = col["ptype"][s:e]
                counts += np.bincount(kind, minlength=6)
                own = fixed[kind] == 0
                for x, v in (
                    ("POS ", np.stack([col[a][s:e] for a in ("x", "y", "z")], 1).astype(real)),
                    ("VEL ", np.stack([col[a][s:e] for a in ("vx", "vy", "vz")], 1).astype(real)),
                    ("ID  ", col["id"][s:e].astype(whole)),
                    ("MASS", col["mass"][s:e][own].astype(real)),
                ):
                    if v.size:
                        if x not in pieces:
                            pieces[x] = fs.open_output_stream(f"{here}/{x.strip()}")
                        pieces[x].write(v.tobytes())
        if number is not None:
            finish()
        return Written(done)

    def _header(self, counts) -> bytes:
        totals = [int(x) for x in self.o["totals"].split(",")]
        c = {k: float(self.o.get(k, 0)) for k in ("time", "redshift", "boxsize", "omega0", "omegalambda", "hubbleparam")}
        low, high = [t & 0xFFFFFFFF for t in totals], [t >> 32 for t in totals]
        head = _HEADER.pack(*map(int, counts), *[float(x) for x in self.o["masses"].split(",")], c["time"], c["redshift"], 0, 0, *low, 0, int(self.o["files"]), c["boxsize"], c["omega0"], c["omegalambda"], c["hubbleparam"], 0, 0, *high)
        return head.ljust(256, b"\0")

    def commit(self, messages) -> None:
        from pyarrow import fs as pafs

        fs, base = _fs(self.o["path"])
        files = [x for m in messages if m for x in m.files]
        have = [sum(c[t] for _, _, c in files) for t in range(6)]
        if have != [int(x) for x in self.o["totals"].split(",")] or len({x for _, x, _ in files}) < len(files):
            self.abort(messages)
            raise ValueError(f"tasks wrote {have} particles by type, of {self.o['totals']}")
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(base)):
                if f.base_name.startswith("snapshot."):
                    fs.delete_file(f.path)
        for temp, final, _ in files:
            fs.move(temp, final)
        self._clean()

    def abort(self, messages) -> None:
        self._clean()

    def _clean(self) -> None:
        fs, base = _fs(self.o["path"])
        from pyarrow import fs as pafs

        fs.delete_dir(f"{base}/_temporary/{self.job}")
        if not fs.get_file_info(pafs.FileSelector(f"{base}/_temporary")):  # no other job writes
            fs.delete_dir(f"{base}/_temporary")


class GadgetSource(DataSource):
    """Format name ``gadget1``. Options to read: ``rows`` of a range, ``counts`` by type in place of the headers'."""

    @classmethod
    def name(cls) -> str:
        return "gadget1"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), list(schema.names))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), overwrite)


def write_gadget(particles: DataFrame, path: str, time: float, boxsize: float, omega0: float, omegalambda: float, h: float = 1.0, files: int | None = None, double: bool = False, masses: list[float] | None = None, to_kpc: bool = True, labels: bool = False, overwrite: bool = False) -> None:
    """Write a snapshot directory. Lengths go from Mpc to kpc and masses to 1e10 solar masses with ``to_kpc``.

    Ids become 1 .. N in the order (ptype, id). ``masses`` are the header's per-type masses; types with 0 there carry their
    own. A file is one task's work: by default there are as many as keep it to some ten million particles. ``labels``
    writes the second format. A directory that holds a snapshot is refused unless ``overwrite``.
    """
    spark = particles.sparkSession
    spark.dataSource.register(GadgetSource)
    got = {r["ptype"]: r["count"] for r in particles.groupBy("ptype").count().collect()}
    totals = [got.get(t, 0) for t in range(6)]
    files = files or -(-sum(totals) // 10_000_000) or 1
    length, weight = (1e3, 1e-10) if to_kpc else (1.0, 1.0)
    first = [int(v) for v in np.cumsum([0, *totals[:-1]])]
    at = F.lit(0)
    for t, (start, n) in enumerate(zip(first, totals, strict=True)):
        at = F.when(F.col("ptype") == t, F.expr(f"(row - {start}) div {split_counts([n], files)[0][0][1] or 1}")).otherwise(at)
    rows = number_rows(particles, "ptype", "id").withColumn("file", at.cast("int")).withColumn("id", F.col("row") + 1)
    rows = rows.select("ptype", "id", *[(F.col(a) * length).alias(a) for a in "xyz"], "vx", "vy", "vz", (F.col("mass") * weight).alias("mass"), "file")
    opts = {"totals": ",".join(map(str, totals)), "masses": ",".join(str(m * weight) for m in masses or [0.0] * 6), "files": str(files), "double": str(double).lower(), "labels": str(labels).lower(), "time": str(time), "redshift": str(1 / time - 1 if time else 0), "boxsize": str(boxsize * length), "omega0": str(omega0), "omegalambda": str(omegalambda), "hubbleparam": str(h)}
    rows.repartitionById(files, "file").sortWithinPartitions("file", "ptype", "id").write.format("gadget1").options(**opts).mode("overwrite" if overwrite else "append").save(path)


def read_gadget(spark: SparkSession, path: str, columns: list[str] | None = None, rows: int = 1 << 20, counts: list[int] | None = None) -> DataFrame:
    """Particles of a snapshot file or directory, of either format: ``columns`` (all by default), ``rows`` to a task.

    ``counts``: particles by type, for files whose headers do not give them.
    """
    spark.dataSource.register(GadgetSource)
    kinds = {c.split()[0]: c for c in SCHEMA.split(", ")}
    asked = ", ".join(kinds[c] for c in columns or kinds)
    read = spark.read.format("gadget1").schema(asked).option("rows", rows)
    return (read.option("counts", ",".join(map(str, counts))) if counts else read).load(path)
