"""Radial kernels: tables, force splits, softening and their Fourier transfer functions.

A table has ``npts`` values at r = rmax * (1 .. npts) / npts and is 0 at r = 0; between its nodes it is
linear. Tables are plain NumPy on the driver (a few thousand numbers at most) and enter plans as array
literals, so the look-up stays in generated code.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: FFT sizes (products of small primes) in use.
FFT_SIZES = [36, 48, 54, 64, 72, 96, 108, 128, 144, 162, 192, 216, 225, 243, 256, 288, 324, 384, 432, 486, 512, 576]
_erf = np.vectorize(math.erf, otypes=[float])


def nodes(rmax: float, npts: int) -> np.ndarray:
    return rmax * np.arange(1, npts + 1) / npts


def newton(rmax: float, npts: int = 100) -> np.ndarray:
    """-1/r**3."""
    r = nodes(rmax, npts)
    return -1.0 / (r * r * r)


def softened(r: np.ndarray, h: float) -> np.ndarray:
    """-1/r**3 softened by a spline of extent h (2.8 times the softening length)."""
    a = r / h
    inner = -(32 / 15) * (5 - 18 * a**2 + 15 * a**3) / h**3
    with np.errstate(divide="ignore"):
        middle = -(320 - 720 * a + 576 * a**2 - 160 * a**3 - 1.0 / a**3) / (15 * h**3)
        outer = -1.0 / r**3
    return np.where(a < 0.5, inner, np.where(a <= 1, middle, outer))


def split_table(mode: str, rsplit: float, npts: int = 100, r_soft: float | None = None) -> np.ndarray:
    """Short-range kernel on (0, rsplit] of a force split: Newton (softened) less the smooth long range.
    """
    r, big = nodes(rsplit, npts), rsplit
    h = 2.8 * r_soft if r_soft else None
    if h and h > rsplit:
        raise ValueError("the softening extends beyond the split radius")
    base = softened(r, h) if h else -1.0 / r**3
    if mode == "cubic":
        return base + (4 * big - 3 * r) / big**4
    if mode == "quartic":
        return base + (2.5 * big**2 - 1.5 * r**2) / big**5
    if mode == "erf":
        rs = big / 4.5
        total = (_erf(r / (2 * rs)) - 1) / r**3 - np.exp(-((r / (2 * rs)) ** 2)) / (math.sqrt(math.pi) * r**2 * rs)
        if not h:
            return total
        return base + total + 1.0 / r**3
    raise ValueError(f"no force split {mode!r}")


def transfer(mode: str, a: np.ndarray) -> np.ndarray:
    """Fourier transfer of the long-range part at a = k * rsplit; 1 at a = 0."""
    a = np.asarray(a, float)
    safe = np.where(a == 0, 1.0, a)
    if mode == "cubic":
        t = -12 * (np.sin(safe) / safe + 2 * np.cos(safe) / safe**2 - 2 / safe**2) / safe**2
        small = 1 - a**2 / 15
        return np.where(a <= 1e-2, small, t)
    if mode == "quartic":
        t = 15 * ((3 - safe**2) * np.sin(safe) - 3 * safe * np.cos(safe)) / safe**5
        return np.where(a <= 1e-2, 1 - 3 * a**2 / 56, t)
    if mode == "erf":
        return np.exp(-((a / 4.5) ** 2))
    raise ValueError(f"no force split {mode!r}")


def transfer_column(mode: str, a: Column) -> Column:
    """``transfer`` as a column expression."""
    if mode == "cubic":
        t = -12 * (F.sin(a) / a + 2 * F.cos(a) / (a * a) - 2 / (a * a)) / (a * a)
        return F.when(a <= 1e-2, 1 - a * a / 15).otherwise(t)
    if mode == "quartic":
        t = 15 * ((3 - a * a) * F.sin(a) - 3 * a * F.cos(a)) / (a * a * a * a * a)
        return F.when(a <= 1e-2, 1 - 3 * a * a / 56).otherwise(t)
    if mode == "erf":
        return F.exp(-(a / 4.5) * (a / 4.5))
    raise ValueError(f"no force split {mode!r}")


def difference_factor(n: int, r_coarse: float, r_fine: float) -> Callable[[Column], Column]:
    """``difference_weights`` as an expression of a mode's squared whole wave number."""
    def factor(m2: Column) -> Column:
        k = 2 * math.pi * F.sqrt(m2)
        return F.when(m2 == 0, 0.0).otherwise(4 * math.pi * n**3 * (transfer_column("cubic", k * r_fine) - transfer_column("cubic", k * r_coarse)) / (k * k))

    return factor


def fft_size(rsplit: float) -> int:
    """Smallest usable size of at least 6 / rsplit."""
    if rsplit > 0.18:
        raise ValueError("the split radius must be at most 0.18 of the box")
    for n in FFT_SIZES:
        if n >= 6 / rsplit:
            return n
    raise ValueError("the split radius needs too large a lattice")


@dataclass(frozen=True)
class ForceSplit:
    """A split mode, its radius, lattice size and softening."""

    mode: str = "cubic"
    rsplit: float = 0.1
    n: int | None = None
    r_soft: float | None = None
    deconvolve: bool = False

    def __post_init__(self):
        if self.mode not in ("cubic", "quartic", "erf"):
            raise ValueError(f"no force split {self.mode!r}")

    @property
    def size(self) -> int:
        return self.n or fft_size(self.rsplit)

    def table(self, npts: int = 100) -> np.ndarray:
        return split_table(self.mode, self.rsplit, npts, self.r_soft)

    def factor(self) -> Callable[[Column], Column]:
        """``weights`` as an expression of a mode's squared whole wave number."""
        n = self.size

        def factor(m2: Column) -> Column:
            k = 2 * math.pi * F.sqrt(m2)
            w = 4 * math.pi * n**3 * transfer_column(self.mode, k * self.rsplit) / (k * k)
            if self.deconvolve:
                dx = k / n
                w = w * (1 + dx * dx / 6 + (11 / 45) * (dx / 2) * (dx / 2) * (dx / 2) * (dx / 2))
            return F.when(m2 == 0, 0.0).otherwise(w)

        return factor

    def weights(self) -> np.ndarray:
        """(n, n, n) factors from the mass lattice's modes to those of the long-range potential."""
        n = self.size
        k = 2 * np.pi * np.fft.fftfreq(n, 1.0 / n)
        kx, ky, kz = np.meshgrid(k, k, k, indexing="ij")
        k2 = kx**2 + ky**2 + kz**2
        k2[0, 0, 0] = 1
        w = 4 * np.pi * n**3 * transfer(self.mode, np.sqrt(k2) * self.rsplit) / k2
        if self.deconvolve:
            w = w * force_deconvolution(np.sqrt(k2) / n)
        w[0, 0, 0] = 0
        return w


def force_deconvolution(kdx: np.ndarray) -> np.ndarray:
    """Makes up for cloud-in-cell twice (deposit and gather), to fourth order in k times the spacing."""
    return 1 + kdx**2 / 6 + (11 / 45) * (kdx / 2) ** 4


def difference_weights(n: int, r_coarse: float, r_fine: float) -> np.ndarray:
    """Factors of a medium-range lattice: the fine cubic core less the coarse one."""
    k = 2 * np.pi * np.fft.fftfreq(n, 1.0 / n)
    kx, ky, kz = np.meshgrid(k, k, k, indexing="ij")
    k2 = kx**2 + ky**2 + kz**2
    k2[0, 0, 0] = 1
    w = 4 * np.pi * n**3 * (transfer("cubic", np.sqrt(k2) * r_fine) - transfer("cubic", np.sqrt(k2) * r_coarse)) / k2
    w[0, 0, 0] = 0
    return w


def look_up(r: Column, table: np.ndarray | Column, npts: int, rmax: float) -> Column:
    """Table value at r < rmax; the first interval rises linearly from 0."""
    t = F.array(*[F.lit(float(v)) for v in table]) if isinstance(table, np.ndarray) else table
    f = r * npts / rmax
    i = F.least(F.floor(f).cast("int"), F.lit(npts - 1))
    lo = F.when(i == 0, 0.0).otherwise(F.get(t, i - 1))
    return lo + (f - i) * (F.get(t, i) - lo)
