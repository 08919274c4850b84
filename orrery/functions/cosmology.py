"""Expansion, growth and power spectra: scalars of the driver, by Gauss-Legendre quadrature."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

#: Newton's constant in km**2 Mpc / (s**2 solar masses).
G = 4.3009e-9
_X, _W = np.polynomial.legendre.leggauss(64)

Spectrum = Callable[[np.ndarray], np.ndarray]


def integrate(f, lo: float, hi: float, panels: int = 16) -> float:
    """64-node Gauss-Legendre on equal panels."""
    edge = np.linspace(lo, hi, panels + 1)
    mid, half = (edge[1:] + edge[:-1]) / 2, (edge[1:] - edge[:-1]) / 2
    return float(((f(mid[:, None] + half[:, None] * _X) * _W).sum(1) * half).sum())


def hubble(a, h0: float, om: float, ol: float):
    """H(a) with the curvature that closes the budget."""
    ok = 1 - om - ol
    return h0 * np.sqrt((om / a + ok) / a**2 + ol)


def growth(a: float, om: float, ol: float) -> float:
    """Linear growth factor, 1 at a = 1."""
    ok = 1 - om - ol

    def upto(x: float) -> float:
        f = lambda t: (t / (om + ok * t + ol * t**3)) ** 1.5
        return float(hubble(x, 1.0, om, ol)) * integrate(f, 0.0, x)

    return upto(a) / upto(1.0)


def velocity_factor(a: float, h0: float, om: float, ol: float) -> float:
    """Peculiar velocity (comoving rate) per unit of displacement: H(a) * Omega_m(a)**0.6."""
    h = float(hubble(a, h0, om, ol))
    om_a = om * h0**2 / (a**3 * h**2)
    return h * om_a**0.6


def window(x: np.ndarray) -> np.ndarray:
    """Top-hat window of radius r at x = k r."""
    x = np.asarray(x, float)
    safe = np.where(x < 1e-2, 1.0, x)
    return np.where(x < 1e-2, 1 - x**2 / 10, 3 * (np.sin(safe) - safe * np.cos(safe)) / safe**3)


def tophat_variance(p: Spectrum, r: float, panels: int = 400) -> float:
    """Variance in spheres of radius r for a spectrum that carries (2 pi)**-3; k from 1e-8 to 500 / r."""
    f = lambda t: 4 * np.pi * np.exp(3 * t) * window(np.exp(t) * r) ** 2 * p(np.exp(t))
    return integrate(f, math.log(1e-8), math.log(500 / r), panels)


def efstathiou(gamma: float = 0.21, ns: float = 1.0) -> Spectrum:
    """Analytic cold dark matter spectrum, not normalised. The fit's four constants."""
    a, b, c, nu = 6.4 / gamma, 3.0 / gamma, 1.7 / gamma, 1.13
    return lambda k: np.asarray(k, float) ** ns / (1 + (a * k + (b * k) ** 1.5 + (c * k) ** 2) ** nu) ** (2 / nu)


def tabulated(k: np.ndarray, p: np.ndarray, ns: float = 0.96) -> Spectrum:
    """Log-log interpolation of a table, continued for ten e-folds by k**ns below and k**(ns - 4) above."""
    lk, lp = np.log(np.asarray(k, float)), np.log(np.asarray(p, float))
    lk = np.concatenate([[lk[0] - 10], lk, [lk[-1] + 10]])
    lp = np.concatenate([[lp[0] - 10 * ns], lp, [lp[-1] + 10 * (ns - 4)]])
    return lambda q: np.exp(np.interp(np.log(q), lk, lp))


def normalised(p: Spectrum, sigma8: float, a: float, om: float, ol: float) -> Spectrum:
    """A spectrum scaled to sigma8 today and grown to a."""
    f = sigma8**2 / tophat_variance(p, 8.0) * growth(a, om, ol) ** 2
    return lambda k: f * p(k)


def critical_density(h0: float) -> float:
    return 3 * h0**2 / (8 * math.pi * G)


def particle_mass(size: float, om: float, h0: float = 100.0, h: float = 1.0) -> float:
    """Mass of a cell of ``size`` (per h) at matter fraction ``om``, in the units of G, per h."""
    return om * critical_density(h0 * h) * (size / h) ** 3 * h
