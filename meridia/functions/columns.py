"""Column expressions shared by the operators."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_53 = float(2**53)


def r(col: Column | str, digits: int = 6) -> Column:
    """Rounded report value; adding 0.0 turns -0.0 into 0.0."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col, digits) + F.lit(0.0)


def to_number(col: Column | str) -> Column:
    """Text to double; anything unparseable or not finite becomes NULL."""
    return finite((F.col(col) if isinstance(col, str) else col).try_cast("double"))


def to_utc(col: Column | str) -> Column:
    """Text or naive timestamp to a UTC timestamp; unparseable becomes NULL."""
    return (F.col(col) if isinstance(col, str) else col).try_cast("timestamp")


def finite(col: Column) -> Column:
    """NULL for NaN and infinities (Spark orders NaN above infinity)."""
    return F.when(F.abs(col) < F.lit(float("inf")), col)


def finite_or_zero(col: Column) -> Column:
    return F.coalesce(finite(col), F.lit(0.0))


def ratio(num: Column, den: Column) -> Column:
    """num / den, NULL when den is 0."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def clip(col: Column, lo, hi) -> Column:
    """Clamp to [lo, hi]; NULL stays NULL."""
    lo = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi = hi if isinstance(hi, Column) else F.lit(float(hi))
    return F.when(col < lo, lo).when(col > hi, hi).otherwise(col)


def uniform(*key, seed: int = 0) -> Column:
    """Uniform in (0,1) that depends only on the row key and the seed, never on partitioning."""
    h = F.xxhash64(*[k if isinstance(k, Column) else F.col(k) for k in key], F.lit(seed))
    return (F.pmod(h, F.lit(2**53)).cast("double") + F.lit(0.5)) / F.lit(TWO_53)


def gaussian(*key, seed: int = 0) -> Column:
    """Standard normal keyed like :func:`uniform` (Box-Muller)."""
    u, v = uniform(*key, seed=2 * seed + 1), uniform(*key, seed=2 * seed + 2)
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2.0 * math.pi) * v)


def exact_sum(col: Column | str) -> Column:
    """Aggregate: sum of doubles as they print, to 18 decimals, so that no order of the rows changes it (below 1e20)."""
    return F.sum((F.col(col) if isinstance(col, str) else col).cast("decimal(38,18)")).cast("double")


def exact_mean(col: Column | str) -> Column:
    """Aggregate: mean by :func:`exact_sum`; NULL values do not count."""
    return F.try_divide(exact_sum(col), F.count(col))


def total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def micros(col: Column | str) -> Column:
    return F.unix_micros(F.col(col) if isinstance(col, str) else col)


def hour_of_day(col: Column | str) -> Column:
    """Decimal UTC hour: hour + minute/60 + whole second/3600."""
    c = F.col(col) if isinstance(col, str) else col
    return F.hour(c) + F.minute(c) / F.lit(60.0) + F.second(c) / F.lit(3600.0)


def correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation, NULL when either side is constant (the built-in raises there in ANSI mode)."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
