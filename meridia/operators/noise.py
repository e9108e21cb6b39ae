"""Noise of private releases: discrete Gaussians from a secret key, and the budget they spend.

A release draws one key from the system's entropy and derives every group's noise from
the key and the group's name by an extendable hash.  A retried task thus repeats its
noise, another release does not, and the key stays out of plans and results.  Values
are rounded to a binary grid about a millionth of the noise wide and integer noise is
added on it by exact rejection sampling, so no digit of the sum tells where it came from.
"""

from __future__ import annotations

import hashlib
import math
import secrets
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Grid steps in one standard deviation, as a power of two.
FINE = 20


def new_key(seed: int | None = None) -> bytes:
    """The key of one release; ``seed`` makes it repeatable, for tests and simulations only."""
    return secrets.token_bytes(32) if seed is None else hashlib.sha256(f"seed {seed}".encode()).digest()


class Stream:
    """Random integers derived from a key and a label."""

    def __init__(self, key: bytes, label: str):
        self._start, self._block, self._pool, self._held = key + label.encode(), 0, 0, 0

    def _bits(self, n: int) -> int:
        while self._held < n:
            part = hashlib.shake_256(self._start + self._block.to_bytes(8, "big")).digest(128)
            self._pool |= int.from_bytes(part, "big") << self._held
            self._held += 1024
            self._block += 1
        out = self._pool & ((1 << n) - 1)
        self._pool >>= n
        self._held -= n
        return out

    def below(self, n: int) -> int:
        """Uniform in 0..n-1."""
        size = n.bit_length()
        while (x := self._bits(size)) >= n:
            pass
        return x

    def falls(self, num: int, den: int) -> bool:
        """True with probability exp(-num / den), exactly."""
        for _ in range(num // den):
            if not self._falls_once(1, 1):
                return False
        return self._falls_once(num % den, den)

    def _falls_once(self, num: int, den: int) -> bool:
        k = 1
        while self.below(den * k) < num:
            k += 1
        return k % 2 == 1

    def laplace(self, scale: int) -> int:
        """Integers with probability proportional to exp(-|x| / scale)."""
        while True:
            low = self.below(scale)
            if not self.falls(low, scale):
                continue
            high = 0
            while self.falls(1, 1):
                high += 1
            size, negative = low + scale * high, self.below(2)
            if size or not negative:
                return -size if negative else size

    def gaussian(self, sigma: int) -> int:
        """Integers with probability proportional to exp(-x**2 / (2 sigma**2))."""
        t = sigma + 1
        while True:
            x = self.laplace(t)
            if self.falls((abs(x) * t - sigma * sigma) ** 2, 2 * (sigma * t) ** 2):
                return x


def noisy(value: float, sigma: float, stream: Stream) -> float:
    """``value`` on the grid plus discrete Gaussian noise of at least ``sigma``; without noise the value itself."""
    if not sigma > 0 or not math.isfinite(sigma) or not math.isfinite(value):
        return value
    exponent = math.floor(math.log2(sigma)) - FINE
    # rounding moves the value by a step at most: two steps more of noise cover that
    steps = math.ceil(math.ldexp(sigma, -exponent)) + 2
    return math.ldexp(round(math.ldexp(value, -exponent)) + stream.gaussian(steps), exponent)


def released(value: Column, sigma: Column, labels: list[str], key: bytes) -> Column:
    """:func:`noisy` per row, each group by its labels."""

    @F.pandas_udf("double")
    def draw(label: pd.Series, v: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([noisy(a, b, Stream(key, name)) for name, a, b in zip(label, v, s, strict=True)], dtype="float64")

    named = F.to_json(F.struct(*labels), {"ignoreNullFields": "false"}) if labels else F.lit("all")
    return draw(named, value.cast("double"), sigma.cast("double"))


@dataclass
class Ledger:
    """A budget of epsilon and delta; every release enters what it spends, by sequential composition."""

    eps: float
    delta: float
    entries: list[tuple[str, float, float]] = field(default_factory=list)

    def spend(self, name: str, eps: float, delta: float) -> None:
        eps_after, delta_after = (sum(x) for x in zip(self.spent, (eps, delta), strict=True))
        if eps_after > self.eps * (1 + 1e-12) or delta_after > self.delta * (1 + 1e-12):
            raise ValueError(f"{name} would spend epsilon {eps_after:g} of {self.eps:g}, delta {delta_after:g} of {self.delta:g}")
        self.entries.append((name, eps, delta))

    @property
    def spent(self) -> tuple[float, float]:
        return sum(e for _, e, _ in self.entries), sum(d for _, _, d in self.entries)
