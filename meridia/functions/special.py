"""Scalar distribution functions for critical values and intervals (driver side, a few calls per query)."""

from __future__ import annotations

import math

import numpy as np


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(abs(1.0 - (a + b) * x / (a + 1.0)), tiny) * math.copysign(1.0, 1.0 - (a + b) * x / (a + 1.0))
    out = d
    for m in range(1, 10_000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return out


def beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def f_quantile(q: float, d1: float, d2: float) -> float:
    """Value below which a share ``q`` of the F distribution lies (bisection on the beta scale)."""
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if beta_cdf(mid, d1 / 2, d2 / 2) < q:
            lo = mid
        else:
            hi = mid
    x = (lo + hi) / 2
    return math.inf if x >= 1.0 else d2 * x / (d1 * (1.0 - x))


def critical_correlation(n: float, alpha: float = 0.05) -> float:
    """Smallest |r| whose two-sided p-value is below ``alpha`` with ``n`` rows."""
    if n <= 2:
        return math.inf
    t2 = f_quantile(1.0 - alpha, 1.0, n - 2.0)
    return math.sqrt(t2 / (n - 2.0 + t2))


# Wichura's algorithm AS 241 (PPND16), numerator and denominator of each range, highest power first.
MIDDLE_UP = (
    2509.0809287301227, 33430.57558358813, 67265.7709270087, 45921.95393154987,
    13731.69376550946, 1971.5909503065513, 133.14166789178438, 3.3871328727963665,
)
MIDDLE_DOWN = (
    5226.495278852854, 28729.085735721943, 39307.89580009271, 21213.794301586597,
    5394.196021424751, 687.1870074920579, 42.31333070160091, 1.0,
)
TAIL_UP = (
    0.0007745450142783414, 0.022723844989269184, 0.2417807251774506, 1.2704582524523684,
    3.6478483247632045, 5.769497221460691, 4.630337846156546, 1.4234371107496835,
)
TAIL_DOWN = (
    1.0507500716444169e-09, 0.0005475938084995345, 0.015198666563616457, 0.14810397642748008,
    0.6897673349851, 1.6763848301838038, 2.053191626637759, 1.0,
)
FAR_UP = (
    2.0103343992922881e-07, 2.7115555687434876e-05, 0.0012426609473880784, 0.026532189526576124,
    0.29656057182850487, 1.7848265399172913, 5.463784911164114, 6.657904643501103,
)
FAR_DOWN = (
    2.0442631033899397e-15, 1.421511758316446e-07, 1.8463183175100548e-05, 0.0007868691311456133,
    0.014875361290850615, 0.1369298809227358, 0.599832206555888, 1.0,
)


def normal_quantile(p):
    """Inverse normal distribution function of an array of probabilities inside (0, 1)."""
    q = p - 0.5
    root = np.sqrt(-np.log(np.minimum(p, 1.0 - p)))
    ratio = lambda up, down, r: np.polyval(up, r) / np.polyval(down, r)
    middle = q * ratio(MIDDLE_UP, MIDDLE_DOWN, 0.180625 - q * q)
    outer = np.where(root <= 5.0, ratio(TAIL_UP, TAIL_DOWN, root - 1.6), ratio(FAR_UP, FAR_DOWN, root - 5.0))
    return np.where(np.abs(q) <= 0.425, middle, np.copysign(outer, q))
