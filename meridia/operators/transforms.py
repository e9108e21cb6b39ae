"""Column transforms by name, learned in aggregates and applied as expressions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridia.functions.special import normal_quantile
from meridia.operators.ordered import ordered, quantiles
from meridia.session import durable


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    return wide.unpivot([], columns, "column", "x").where(F.col("x").isNotNull())


def _replace(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    return df.select(*[exprs[c].alias(c) if c in exprs else F.col(c) for c in df.columns])


def standard(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population sd; a constant column is only centred."""
    aggs = [a for c in columns for a in (F.avg(c), F.stddev_pop(c))]
    row = df.agg(*aggs).first()
    out = {}
    for i, c in enumerate(columns):
        mean, sd = row[2 * i], row[2 * i + 1]
        out[c] = (F.col(c) - F.lit(mean)) / F.lit(sd if sd else 1.0)
    return _replace(df, out)


def robust(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - median) / interquartile range, exact quantiles of all columns in one pass."""
    q = quantiles(_long(df, columns), ["column"], "x", {"lo": 0.25, "mid": 0.5, "hi": 0.75}).collect()
    by = {row["column"]: row for row in q}
    return _replace(df, {
        c: (F.col(c) - F.lit(by[c]["mid"])) / F.lit((by[c]["hi"] - by[c]["lo"]) or 1.0) for c in columns if c in by})


def log(df: DataFrame, columns: list[str]) -> DataFrame:
    return standard(_replace(df, {c: F.log1p(c) for c in columns}), columns)


def yeo_johnson(x: Column, lam: float) -> Column:
    up = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    rest = 2.0 - lam
    down = -F.log1p(-x) if abs(rest) < 1e-12 else -(F.pow(1 - x, F.lit(rest)) - 1) / rest
    return F.when(x >= 0, up).otherwise(down)


def counted(df: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct values of every column, stored: column (its place in ``columns``), x, n rows."""
    parts = F.array(*[F.struct(F.lit(i).alias("column"), F.col(c).cast("double").alias("x")) for i, c in enumerate(columns)])
    return durable(df.select(F.inline(parts)).where(F.col("x").isNotNull()).groupBy("column", "x").agg(
        F.count(F.lit(1)).alias("n")), "counted")


def _shifted(x: np.ndarray, lam: float) -> np.ndarray:
    """Yeo-Johnson values of numbers, as :func:`yeo_johnson`."""
    up, rest, size = x >= 0, 2.0 - lam, np.abs(x)
    with np.errstate(over="ignore", invalid="ignore"):
        pos = np.log1p(size) if abs(lam) < 1e-12 else (np.power(size + 1, lam) - 1) / lam
        neg = -np.log1p(size) if abs(rest) < 1e-12 else -(np.power(size + 1, rest) - 1) / rest
    return np.where(up, pos, neg)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """n, mean and squared deviations of the union of groups given by theirs."""
    n, mean, m2 = parts[0]
    for k, other, more in parts[1:]:
        step, both = other - mean, n + k
        mean, m2, n = mean + step * k / both, m2 + more + step * step * n * k / both, both
    return np.array([n, mean, m2])


def power_moments(values: DataFrame, grids: dict[int, list[float]]) -> dict[int, list[np.ndarray]]:
    """n, mean and squared deviations of sign(x) log(1 + |x|), then of x under each exponent of its column's grid.

    One pass over :func:`counted`; a task sends three numbers per column and exponent to the driver.
    """
    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for c, part in pdf.groupby("column", sort=False):
                x, n = part["x"].to_numpy(float), part["n"].to_numpy(float)
                for i, lam in enumerate([None, *grids[c]]):
                    y = np.sign(x) * np.log1p(np.abs(x)) if lam is None else _shifted(x, lam)
                    d = y - y[0]  # exactly zero where all are equal
                    shift = np.sum(n * d) / n.sum()
                    got = np.array([n.sum(), y[0] + shift, np.sum(n * (d - shift) ** 2)])
                    seen[c, i] = _joined([seen[c, i], got]) if (c, i) in seen else got
        if seen:
            yield pd.DataFrame([(c, i, *m) for (c, i), m in seen.items()], columns=["column", "i", "n", "mean", "m2"])

    found: dict[tuple, list] = {}
    some = values.where(F.col("column").isin(list(grids)))
    for row in some.mapInPandas(local, "column int, i int, n double, mean double, m2 double").collect():
        found.setdefault((row["column"], row["i"]), []).append(np.array([row["n"], row["mean"], row["m2"]]))
    return {c: [_joined(found[c, i]) for i in range(len(g) + 1)] if (c, 0) in found else [] for c, g in grids.items()}


def power_lambdas(df: DataFrame, columns: list[str], lo: float = -3.0, hi: float = 5.0, points: int = 9, tol: float = 1e-4,
                  values: DataFrame | None = None) -> dict[str, float]:
    """Maximum-likelihood exponents: each round scores a grid for every column in one pass over its distinct values.

    A bracket shrinks around its best point; while that lies on the edge it moves and widens
    instead, so the start does not confine the exponent.
    """
    values = counted(df, columns) if values is None else values
    centre, width = {c: (hi + lo) / 2 for c in columns}, {c: (hi - lo) / 2 for c in columns}
    for _ in range(60):
        open_ = [c for c in columns if width[c] > tol]
        if not open_:
            return centre
        grids = {c: [float(centre[c] + width[c] * t) for t in np.linspace(-1, 1, points)] for c in open_}
        got = power_moments(values, {columns.index(c): g for c, g in grids.items()})
        for c in open_:
            logs, *spreads = got[columns.index(c)] or [np.zeros(3)] * (points + 1)
            n, j = logs[0], logs[0] * logs[1]
            var = [float(m[2] / n) if n else 0.0 for m in spreads]
            scores = [-n / 2 * math.log(s) + (lam - 1) * j if 0 < s < math.inf else -math.inf for lam, s in zip(grids[c], var)]
            best = int(np.argmax(scores))
            if scores[best] == -math.inf:  # a constant column: any exponent will do
                centre[c], width[c] = 1.0, 0.0
                continue
            centre[c] = grids[c][best]
            width[c] *= 1.5 if best in (0, points - 1) else 2.0 / (points - 1)
    raise RuntimeError(f"no largest likelihood within reach for {[c for c in columns if width[c] > tol]}")


def power(df: DataFrame, columns: list[str]) -> DataFrame:
    """Yeo-Johnson with maximum-likelihood exponents, then (y - mean) / population sd; a constant column is only centred."""
    values = counted(df, columns)
    lams = power_lambdas(df, columns, values=values)
    spread = power_moments(values, {i: [lams[c]] for i, c in enumerate(columns)})
    out = {}
    for i, c in enumerate(columns):
        n, mean, m2 = spread[i][1] if spread[i] else (1.0, 0.0, 0.0)
        out[c] = (yeo_johnson(F.col(c).cast("double"), lams[c]) - F.lit(float(mean))) / F.lit(math.sqrt(m2 / n) or 1.0)
    return _replace(df, out)


def reference_quantiles(df: DataFrame, columns: list[str], n_max: int = 1000) -> dict[str, np.ndarray]:
    """Up to ``n_max`` evenly spaced exact quantiles per column."""
    counted = _long(df, columns).groupBy("column", "x").agg(F.count(F.lit(1)).alias("c"))
    placed = ordered(counted, ["column"], ["x"], sums={"cum": F.col("c")}, totals=True, lead={"x_next": "x"})
    n = F.col("cum_total")
    nq = F.greatest(F.lit(2), F.least(F.lit(n_max), n))
    scale = (nq - 1) / F.greatest(n - 1, F.lit(1))
    first = F.ceil((F.col("cum") - F.col("c")) * scale - 1e-9).cast("int")
    last = F.least(F.ceil(F.col("cum") * scale - 1e-9).cast("int") - 1, nq.cast("int") - 1)
    hits = placed.withColumn("first", first).withColumn("last", last).withColumn("scale", scale).where("last >= first")
    hits = hits.withColumn("i", F.explode(F.sequence("first", "last")))
    at = F.col("i") / F.col("scale")
    whole = F.floor(at + 1e-9)
    after = F.when(whole + 1 < F.col("cum"), F.col("x")).otherwise(F.coalesce("x_next", "x"))
    rows = hits.select("column", "i", (F.col("x") + (after - F.col("x")) * F.greatest(at - whole, F.lit(0.0))).alias("q")).collect()
    out: dict[str, list] = {c: [] for c in columns}
    for row in sorted(rows, key=lambda r: r["i"]):  # at most n_max per column
        out[row["column"]].append(row["q"])
    return {c: np.array(v) for c, v in out.items()}


def quantile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rank to normal scores through the reference quantiles, ends clipped."""
    refs = reference_quantiles(df, columns)
    cut = 1e-7

    def scorer(ref: np.ndarray):
        share = np.linspace(0, 1, len(ref))
        @F.pandas_udf(T.DoubleType())
        def score(x: pd.Series) -> pd.Series:
            v = x.to_numpy(float)
            p = (np.interp(v, ref, share) - np.interp(-v, -ref[::-1], -share[::-1])) / 2
            p = np.where(v <= ref[0], 0.0, np.where(v >= ref[-1], 1.0, p))  # ties at the ends sit on the ends
            return pd.Series(normal_quantile(np.clip(p, cut, 1 - cut)))

        return score

    return _replace(df, {c: scorer(refs[c])(F.col(c).cast("double")) for c in columns})


TRANSFORMS = {
    "none": lambda df, columns: df, "standard": standard, "robust": robust, "log": log, "power": power, "quantile": quantile,
}


def apply_transform(name: str, df: DataFrame, columns: list[str]) -> DataFrame:
    if name not in TRANSFORMS:
        raise ValueError(f"unknown transform {name!r}; choose from {sorted(TRANSFORMS)}")
    return TRANSFORMS[name](df, columns)
