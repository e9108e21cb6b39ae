"""Sufficient statistics for every linear operator: fold-wise cross products.

Rows are vectors z = [1, x..., y...].  Each task sums z z' per fold over its own
rows (numpy inside the task), a second stage merges those partial sums, and at
most MERGE_WAYS matrices per fold reach the driver, one at a time.  Train statistics of a fold are
total minus fold, so K folds cost one pass and a held-out row never enters a fit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MERGE_WAYS = 32
#: Most rows of a batch made dense at once.
ROWS = 1024
MAX_DRIVER_DOUBLES = 64_000_000


def vector(columns: list[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in columns])


def design(df: DataFrame, x: Column, ys: list[Column], keep: list[str]) -> DataFrame:
    """keep columns + ``z`` = [1, x..., y...]."""
    parts = [F.array(F.lit(1.0)), F.transform(x, lambda v: v.cast("double"))]
    if ys:
        parts.append(F.array(*[y.cast("double") for y in ys]))
    return df.select(*keep, F.concat(*parts).alias("z"))


def _merge(batches: Iterator[pd.DataFrame], cells: list[str]) -> Iterator[pd.DataFrame]:
    sums: dict[tuple, np.ndarray] = {}
    for pdf in batches:
        for key, part in pdf.groupby(cells, sort=False, dropna=False):
            total = np.sum(np.stack(part["v"].to_numpy()), axis=0)
            sums[key] = sums[key] + total if key in sums else total
    if sums:
        out = pd.DataFrame(list(sums), columns=cells)
        out["v"] = list(sums.values())
        yield out


def summed(df: DataFrame, cells: list[str], each: Callable[..., np.ndarray], keyed: bool = False) -> DataFrame:
    """Sum ``each(block of z rows)`` (a flat vector) per cell: at most MERGE_WAYS rows per cell, cells + v.

    With ``keyed`` the function also gets the cell's key tuple.
    """
    dtypes = dict(df.dtypes)
    head = ", ".join(f"{c} {dtypes[c]}" for c in cells)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for key, part in pdf.groupby(cells, sort=False, dropna=False):
                for at in range(0, len(part), ROWS):
                    z = np.stack(part["z"].to_numpy()[at:at + ROWS]).astype(float, copy=False)
                    got = each(z, key) if keyed else each(z)
                    sums[key] = sums[key] + got if key in sums else got
        if sums:
            out = pd.DataFrame(list(sums), columns=cells)
            out["salt"] = TaskContext.get().partitionId() + np.arange(len(out))
            out["v"] = list(sums.values())
            yield out

    partial = df.select(*cells, "z").mapInPandas(local, f"{head}, salt bigint, v array<double>")
    spread = partial.withColumn("salt", F.pmod(F.col("salt"), F.lit(MERGE_WAYS)))
    return spread.repartition(*cells, "salt").mapInPandas(
        lambda it: _merge(it, cells), f"{head}, v array<double>"
    )


@dataclass
class Grams:
    """Cross products of z about ``centre`` per cell; entry [0,0] is the row count."""

    cells: dict
    centre: np.ndarray
    p: int

    @property
    def total(self) -> np.ndarray:
        return sum(self.cells.values())

    def without(self, drop: Callable[[object], bool]) -> np.ndarray:
        """Sum over the cells ``drop`` does not select."""
        kept = [g for c, g in self.cells.items() if not drop(c)]
        return sum(kept) if kept else np.zeros_like(self.total)


def near_mean(df: DataFrame) -> np.ndarray:
    """The mean of all rows, to centre on: one aggregate.

    Any centre gives the same results up to rounding; the mean avoids cancellation.
    """
    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = 0.0, 0
        for pdf in batches:
            if len(pdf):
                total, n = total + np.sum(np.stack(pdf["z"].to_numpy()).astype(float), axis=0), n + len(pdf)
        if n:
            yield pd.DataFrame({"n": [n], "v": [total]})

    parts = df.select("z").mapInPandas(local, "n bigint, v array<double>").select("n", F.posexplode("v").alias("i", "s"))
    mean = parts.groupBy("i").agg((F.sum("s") / F.sum("n")).alias("m")).collect()  # one number per column
    if not mean:
        raise ValueError("no rows to fit on")
    return np.array([row["m"] for row in sorted(mean, key=lambda r: r["i"])])


def grams(df: DataFrame, cells: list[str], labels: int) -> Grams:
    """Centred cross products per cell of a :func:`design` frame whose last ``labels`` entries are labels."""
    centre = near_mean(df)
    centre[0] = 0.0  # keep the constant column so counts and sums stay available
    q = len(centre)

    def products(z: np.ndarray) -> np.ndarray:
        c = z - centre
        return (c.T @ c).ravel()

    got: dict = {}
    for row in summed(df, cells, products).toLocalIterator(prefetchPartitions=True):
        key = row[0] if len(cells) == 1 else tuple(row[:-1])
        part = np.asarray(row["v"]).reshape(q, q)
        got[key] = got[key] + part if key in got else part
        if len(got) * q * q > MAX_DRIVER_DOUBLES:
            raise ValueError("too many fold matrices for the driver: use fewer folds or features")
    return Grams(got, centre, q - 1 - labels)


# ---- solvers on one (q x q) matrix; features 1..p, labels p+1..

@dataclass
class Moments:
    n: float
    mean: np.ndarray
    cov: np.ndarray  # population covariance of [x..., y...]
    p: int

    @property
    def sd(self) -> np.ndarray:
        s = np.sqrt(np.clip(np.diag(self.cov)[: self.p], 0, None))
        return np.where(s > 1e-12, s, 1.0)

    def standardized(self) -> tuple[np.ndarray, np.ndarray]:
        """Correlation-scale X'X/n and X'y/n."""
        s = self.sd
        return self.cov[: self.p, : self.p] / np.outer(s, s), self.cov[: self.p, self.p:] / s[:, None]


def moments(g: np.ndarray, p: int, centre: np.ndarray) -> Moments:
    n = g[0, 0]
    m = g[0, 1:] / n
    cov = g[1:, 1:] / n - np.outer(m, m)
    return Moments(n, m + centre[1:], cov, p)


def unstandardize(mo: Moments, beta: np.ndarray) -> np.ndarray:
    """Standardized coefficients (p x labels) -> [intercept, raw coefficients] (p+1 x labels)."""
    raw = beta / mo.sd[:, None]
    icept = mo.mean[mo.p:] - mo.mean[: mo.p] @ raw
    return np.vstack([icept, raw])


def ridge(mo: Moments, alpha: float, use: np.ndarray | None = None) -> np.ndarray:
    """Standardized ridge (alpha 0: least squares by pseudo-inverse), raw coefficients per label."""
    a, b = mo.standardized()
    idx = np.arange(mo.p) if use is None else use
    beta = np.zeros((mo.p, b.shape[1]))
    sub = a[np.ix_(idx, idx)]
    if alpha:
        beta[idx] = np.linalg.solve(sub + alpha / mo.n * np.eye(len(idx)), b[idx])
    else:
        beta[idx] = np.linalg.pinv(sub, rcond=1e-10, hermitian=True) @ b[idx]
    return unstandardize(mo, beta)


def elastic_net(mo: Moments, alphas: np.ndarray, l1: np.ndarray, use: np.ndarray | None = None,
                sweeps: int = 10_000, tol: float = 1e-7) -> np.ndarray:
    """Coordinate descent on the covariance form for every (alpha, l1) pair at once.

    Objective 1/(2n)|y-Xb|^2 + a r |b|_1 + a(1-r)/2 |b|^2 on standardized features,
    first label.  Returns raw [intercept, coefficients] as (p+1 x pairs).  Raises if
    a coefficient still moves by ``tol`` or more in the last sweep.
    """
    a, b = mo.standardized()
    idx = np.arange(mo.p) if use is None else use
    g, c = a[np.ix_(idx, idx)], b[idx, 0]
    beta = np.zeros((len(alphas), len(idx)))
    gb = np.zeros_like(beta)
    lasso, shrink = alphas * l1, alphas * (1 - l1)
    for _ in range(sweeps):
        moved = 0.0
        for j in range(len(idx)):
            rho = c[j] - gb[:, j] + g[j, j] * beta[:, j]
            new = np.sign(rho) * np.maximum(np.abs(rho) - lasso, 0) / (g[j, j] + shrink + 1e-15)
            step = new - beta[:, j]
            if np.any(step):
                gb += step[:, None] * g[j]
                beta[:, j] = new
                moved = max(moved, float(np.max(np.abs(step))))
        if moved < tol:
            break
    else:
        raise ValueError(f"elastic net not converged after {sweeps} sweeps")
    full = np.zeros((mo.p, len(alphas)))
    full[idx] = beta.T
    raw = full / mo.sd[:, None]
    icept = mo.mean[mo.p] - mo.mean[: mo.p] @ raw
    return np.vstack([icept, raw])


def held_out(g: np.ndarray, centre: np.ndarray, p: int, coef: np.ndarray, label: np.ndarray | int) -> np.ndarray:
    """Sums over a held-out cell from its matrix alone: n, y, p, yy, pp, yp per model column."""
    q = g.shape[0]
    k = coef.shape[1]
    labels = np.full(k, label) if np.isscalar(label) else label
    # prediction as a combination of centred z: intercept absorbs the centre
    w = np.zeros((q, k))
    w[0] = coef[0] + centre[1: p + 1] @ coef[1:]
    w[1: p + 1] = coef[1:]
    u = np.zeros((q, k))
    u[0] = centre[p + 1 + labels]
    u[p + 1 + labels, np.arange(k)] = 1.0
    one = g[0]
    return np.array([
        np.full(k, g[0, 0]), one @ u, one @ w,
        np.einsum("ik,ij,jk->k", u, g, u), np.einsum("ik,ij,jk->k", w, g, w), np.einsum("ik,ij,jk->k", u, g, w),
    ])


def pooled_scores(sums: np.ndarray) -> dict[str, np.ndarray]:
    """R2, RMSE and Pearson from pooled held-out sums."""
    n, y, p, yy, pp, yp = sums
    sse, sst = yy - 2 * yp + pp, yy - y * y / n
    with np.errstate(divide="ignore", invalid="ignore"):
        return {
            "R2": 1 - sse / sst, "RMSE": np.sqrt(np.maximum(sse, 0) / n),
            "Pearson": (yp - y * p / n) / np.sqrt((yy - y * y / n) * (pp - p * p / n)),
        }
