"""Fixed-size tables over hashed values: how often each slot was hit, on a scale of 16 levels.

A slot table is built from all rows, with a partial count in each task and a sum per range of slots;
its size depends on ``bits`` alone, which is the proven bound of what is broadcast. Users of a table may
only use it for things where a collision costs time and never changes a result: an order of tokens, or
a filter that lets too much through.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import textkernel as tk

SCHEMA = "part int, counts binary"
#: Slots per row of a partial table.
WIDTH = 1 << 14
WIDE = 1 << 16
#: The highest level: 182 hits or more, and at least FULL times the mean of all slots.
TOP = 15
FULL = 8


class Partial:
    """Counts of one task. ``rows()`` gives its non-empty stretches; a count stops at what ``kind`` holds."""

    def __init__(self, bits: int, kind=np.uint16):
        self.bits = bits
        self.counts = np.zeros(1 << bits, kind)

    def add(self, hashes: np.ndarray) -> None:
        """Count 64-bit hashes, each time one occurs; the top bits choose the slot."""
        slot = np.sort((hashes >> np.uint64(64 - self.bits)).astype(np.int64))
        if not len(slot):
            return
        at = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        n = np.diff(np.r_[at, len(slot)])
        s = slot[at]
        self.counts[s] = np.minimum(self.counts[s].astype(np.int64) + n, np.iinfo(self.counts.dtype).max)

    def rows(self):
        for part in range(0, len(self.counts), WIDTH):
            c = self.counts[part : part + WIDTH]
            hit = np.flatnonzero(c)
            if len(hit):
                yield part // WIDTH, pack(hit, c[hit])

    def batches(self):
        """The rows as Arrow batches of (part, counts)."""
        for part, data in self.rows():
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "counts": pa.array([data], pa.binary())})


class Bits:
    """Which slots were hit, in one bit each, for large tables."""

    def __init__(self, bits: int):
        self.bits = bits
        self.hit = np.zeros(1 << (bits - 3), np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        np.bitwise_or.at(self.hit, slot >> 3, (np.uint8(128) >> (slot & 7).astype(np.uint8)).astype(np.uint8))

    def batches(self):
        """Arrow batches of (part, counts), the latter with places of bits alone."""
        for part in range(0, len(self.hit) * 8 // WIDE):
            cut = self.hit[part * WIDE // 8 : (part + 1) * WIDE // 8]
            if cut.any():
                at = np.flatnonzero(np.unpackbits(cut)).astype(np.uint16)
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "counts": pa.array([at.tobytes()], pa.binary())})


def _least(v: np.ndarray):
    return np.dtype(np.uint8 if v.max(initial=0) < 256 else np.uint16)


def pack(hit: np.ndarray, n: np.ndarray) -> bytes:
    """Gaps between hit slots, then counts, each in one byte if all fit."""
    gap = np.diff(hit, prepend=-1)
    g, c = _least(gap), _least(n)
    return struct.pack("<BBI", g.itemsize, c.itemsize, len(hit)) + gap.astype(g).tobytes() + n.astype(c).tobytes()


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    g, c, n = struct.unpack_from("<BBI", data)
    gap = np.frombuffer(data, f"<u{g}", n, 6)
    return np.cumsum(gap, dtype=np.int64) - 1, np.frombuffer(data, f"<u{c}", n, 6 + n * g)


def _sum_parts(unit: float):
    """Adds up as batches arrive: memory is the task's own ranges of slots, whatever the number of rows."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = total.setdefault(part, np.zeros(WIDTH, np.uint32))
                hit, n = unpack(data)
                t[hit] += n
        for part, t in total.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "counts": pa.array([_shrink(_quantise(t, unit))], pa.binary())})

    return run


def _quantise(t: np.ndarray, unit: float) -> np.ndarray:
    """In units: 0, 1, 2, 3 as they are; above, two steps to each doubling, up to TOP."""
    t = np.floor(t / unit)
    big = np.minimum(TOP, np.floor(2 * np.log2(np.maximum(t, 4)))).astype(np.uint8)
    return np.where(t < 4, t, big).astype(np.uint8)


def _shrink(level: np.ndarray) -> bytes:
    """Levels two to a byte, compressed."""
    return zlib.compress((level[::2] << 4 | level[1::2]).tobytes(), 1)


def table(partials: DataFrame, bits: int, hits: int = 0) -> np.ndarray:
    """Levels of (part, counts) rows summed over all tasks, two to a byte; 2**bits / 2 bytes come to the driver.

    ``hits`` is how many there are in all: where slots are full, levels count in units that keep TOP for slots with
    ``FULL`` times the mean.
    """
    unit = max(1.0, FULL * hits / 2**bits / 2 ** (TOP / 2))
    summed = partials.select("part", "counts").repartition("part").mapInArrow(_sum_parts(unit), SCHEMA)
    out = np.zeros(1 << (bits - 1), np.uint8)
    for r in summed.collect():  # packed, and all in one job: an iterator runs a job for each partition, one after the other
        out[r["part"] * WIDTH // 2 : (r["part"] + 1) * WIDTH // 2] = np.frombuffer(zlib.decompress(r["counts"]), np.uint8)
    return out


def _whole_sums(batches):
    """As ``_sum_parts``, but the sums themselves."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for part, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            t = total.setdefault(part, np.zeros(WIDTH, np.uint64))
            hit, n = unpack(data)
            t[hit] += n
    for part, t in total.items():
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "counts": pa.array([zlib.compress(t.tobytes(), 1)], pa.binary())})


def heavy(partials: DataFrame, bits: int, share: float, least: int) -> np.ndarray:
    """A bit table of the slots with more than ``share`` of all hits, and more than ``least``; 8 * 2**bits bytes come to the driver."""
    out = np.zeros(1 << bits, np.uint64)
    for r in partials.select("part", "counts").repartition("part").mapInArrow(_whole_sums, SCHEMA).collect():  # as in ``table``
        out[r["part"] * WIDTH : (r["part"] + 1) * WIDTH] = np.frombuffer(zlib.decompress(r["counts"]), np.uint64)
    return np.packbits(out > max(least, share * float(out.sum())))


def lookup(tab: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Levels of the hashes' slots."""
    bits = len(tab).bit_length()
    slot = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    return tab[slot >> 1] >> ((~slot & 1) << 2).astype(np.uint8) & np.uint8(15)


def members(ids: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bit table that covers every value of a long column."""

    def count(batches):
        p = Bits(bits)
        for b in batches:
            v = b.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            p.add(tk.mix(v))
        yield from p.batches()

    return bit_table(ids.select(F.col(column).cast("long").alias("v")).mapInArrow(count, SCHEMA), bits)


def _or_parts(batches):
    """As ``_sum_parts``, for the rows of ``Bits``; one bit per slot comes out."""
    parts: dict[int, np.ndarray] = {}
    for b in batches:
        for part, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            parts.setdefault(part, np.zeros(WIDE, bool))[np.frombuffer(data, np.uint16)] = True
    for part, m in parts.items():
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "counts": pa.array([zlib.compress(np.packbits(m).tobytes(), 1)], pa.binary())})


def bit_table(partials: DataFrame, bits: int) -> np.ndarray:
    """The slots that any task hit: 2**bits / 8 bytes come to the driver."""
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in partials.select("part", "counts").repartition("part").mapInArrow(_or_parts, SCHEMA).collect():  # as in ``table``
        out[r["part"] * WIDE // 8 : (r["part"] + 1) * WIDE // 8] = np.frombuffer(zlib.decompress(r["counts"]), np.uint8)
    return out


def test_bits(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bits = (len(packed) * 8).bit_length() - 1
    slot = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    return (packed[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 > 0
