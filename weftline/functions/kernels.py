"""Fixed small tables of filters, made on the driver: Gaussian masks, line offsets, and the bias table of asymmetric lines."""

from __future__ import annotations

import math
from functools import cache

import numpy as np

# Mask radius in standard deviations for derivatives of order 0, 1, 2
RADIUS = (3.09023230616781, 3.46087178201605, 3.82922419517181)


def phi0(x: float, sigma: float) -> float:
    """Integral of the Gaussian up to x."""
    return 0.5 * math.erfc(-x / (sigma * math.sqrt(2)))


def phi1(x: float, sigma: float) -> float:
    """The Gaussian."""
    return math.exp(-0.5 * (x / sigma) ** 2) / (math.sqrt(2 * math.pi) * sigma)


def phi2(x: float, sigma: float) -> float:
    """The Gaussian's derivative."""
    return -x / sigma**2 * phi1(x, sigma)


@cache
def gauss_mask(order: int, sigma: float) -> tuple[float, ...]:
    """Mask of a Gaussian derivative, integrated over each pixel, as weights of the offsets -n..n. The end taps take the tail."""
    f = (phi0, phi1, phi2)[order]
    n = math.ceil(RADIUS[order] * sigma)
    inner = [f(-i + 0.5, sigma) - f(-i - 0.5, sigma) for i in range(-n + 1, n)]
    if order == 0:
        return (1 - f(n - 0.5, sigma), *inner, f(-n + 0.5, sigma))
    return (-f(n - 0.5, sigma), *inner, f(-n + 0.5, sigma))


@cache
def line_offsets(radius: int, angles: int) -> tuple[tuple[int, int, int, int], ...]:
    """(angle index, q, dx, dy) of the points of a line filter; angles from -pi/2 in steps of pi / angles."""
    at = lambda k: -math.pi / 2 + k * math.pi / angles
    return tuple((k, q, math.floor(q * math.cos(at(k)) + 0.5), math.floor(q * math.sin(at(k)) + 0.5)) for k in range(angles) for q in range(-radius, radius + 1))


def _bisect(f, lo: np.ndarray, hi: np.ndarray, steps: int = 45) -> np.ndarray:
    """Where f turns from true to false, element by element."""
    for _ in range(steps):
        mid = (lo + hi) / 2
        yes = f(mid)
        lo, hi = np.where(yes, mid, lo), np.where(yes, hi, mid)
    return (lo + hi) / 2


def extents(w: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(extracted width, gradient ratio, line position, strong side width) of smoothed bars of half width w and asymmetry a, for a sigma of 1.

    Edges are where the gradient bends: right of w and left of -w, once each, as (x + w) / (x - w) = (1 - a) exp(2 x w) has one side that falls and one that rises there."""
    right = _bisect(lambda x: (x + w) > (x - w) * (1 - a) * np.exp(np.minimum(2 * x * w, 700)), w, w + 12)
    left = -_bisect(lambda z: (z - w) < (z + w) * (1 - a) * np.exp(-2 * z * w), w, w + 12)
    bell = lambda x: np.exp(-0.5 * x * x)
    slope = lambda x: np.abs(bell(x + w) - (1 - a) * bell(x - w))
    line = -np.log(1 - a) / (2 * w)
    with np.errstate(divide="ignore", invalid="ignore"):
        return right - left, slope(right) / slope(left), line, line - left


@cache
def bias_table(widths: int = 41, ratios: int = 21) -> np.ndarray:
    """(half width, asymmetry, position correction, strong and weak side width) for extracted widths 2, 2.1, .. and gradient ratios 0, 0.05, .., in units of
    sigma: an array (widths, ratios, 5), 0 where no bar shows them. By bisection: the ratio falls with the asymmetry, the extracted width grows with w."""
    shown, ratio = (g.ravel() for g in np.meshgrid(2 + 0.1 * np.arange(widths), 0.05 * np.arange(ratios), indexing="ij"))
    most = np.full(len(shown), 1 - 1e-9)
    asymmetry = lambda w: np.where(ratio >= 1 - 1e-12, 0.0, _bisect(lambda a: extents(w, a)[1] > ratio, np.zeros(len(w)), most, 40))
    w = _bisect(lambda w: extents(w, asymmetry(w))[0] < shown, np.full(len(shown), 1e-3), shown, 40)
    a = asymmetry(w)
    got, r, line, strong = extents(w, a)
    fine = (np.abs(got - shown) < 1e-3) & (np.abs(r - ratio) < 1e-3) & (shown > 2 + 1e-9) & (ratio > 0)
    return np.where(fine[:, None], np.stack([w, a, line, strong, got - strong], axis=1), 0.0).reshape(widths, ratios, 5)
