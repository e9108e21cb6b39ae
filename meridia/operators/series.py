"""Fixed-length resampling of series and vector embeddings of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.operators import gram as G
from meridia.operators.models import dot

LENGTH = 512


def resample_to_length(placed: DataFrame, everyone: DataFrame | None = None, length: int = LENGTH) -> DataFrame:
    """subject_id, t (0..length-1), v from a placed series (pos, n, g, g_next).

    Longer series: bin means over edges trunc(t * n / length); shorter: linear
    interpolation on [0, 1]; one reading: constant; none (listed in ``everyone``): zeros.
    """
    i, n, g = F.col("pos") - 1, F.col("n"), F.col("g")
    step = n / F.lit(float(length))
    guess = F.floor(i / step)
    guess = F.when(F.floor((guess + 1) * step) <= i, guess + 1).when(F.floor(guess * step) > i, guess - 1).otherwise(guess)
    down = placed.where(n >= length).groupBy("subject_id", guess.cast("int").alias("t")).agg(F.avg("g").alias("v"))

    scale = F.lit(float(length - 1)) / (n - 1)
    first = F.ceil(i * scale).cast("int")
    last = F.when(i == n - 1, F.lit(length - 1)).otherwise(F.ceil((i + 1) * scale).cast("int") - 1)
    short = placed.where((n < length) & (n > 1)).withColumn("first", first).withColumn("last", last).where("last >= first")
    at = F.col("t") / scale - i
    up = short.withColumn("t", F.explode(F.sequence("first", "last"))).select(
        "subject_id", "t", F.when(i == n - 1, g).otherwise(g + (F.col("g_next") - g) * at).alias("v"))
    every_t = F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("t")
    single = placed.where(n == 1).select("subject_id", every_t, g.alias("v"))
    out = down.unionByName(up).unionByName(single)
    if everyone is not None:
        empty = everyone.select("subject_id").distinct().join(placed.select("subject_id").distinct(), "subject_id", "left_anti")
        out = out.unionByName(empty.select("subject_id", every_t, F.lit(0.0).alias("v")))
    return out


def as_vectors(resampled: DataFrame) -> DataFrame:
    """One array ``x`` per subject (``length`` elements)."""
    packed = F.sort_array(F.collect_list(F.struct("t", "v")))
    return resampled.groupBy("subject_id").agg(packed.alias("p")).select("subject_id", F.transform("p", lambda c: c["v"]).alias("x"))


@dataclass
class VectorReduction:
    """Standardize + principal components learned on one split, reusable on others."""

    coef: np.ndarray  # components x (1 + features): intercept then raw weights
    explained: np.ndarray

    def transform(self, df: DataFrame, x: str, prefix: str = "f") -> DataFrame:
        wide = F.transform(F.col(x), lambda v: v.cast("double"))
        cols = [dot(wide, F.array(*[F.lit(float(v)) for v in c])).alias(f"{prefix}{i}") for i, c in enumerate(self.coef)]
        return df.select("*", *cols)


def principal_axes(corr: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(axes as rows, share of variance); each axis points to its largest loading."""
    lam, vec = np.linalg.eigh(corr)
    order = np.argsort(lam)[::-1][:k]
    axes = vec[:, order].T
    flip = np.sign(axes[np.arange(len(axes)), np.argmax(np.abs(axes), axis=1)])
    return axes * flip[:, None], np.clip(lam[order], 0, None) / max(np.sum(np.clip(lam, 0, None)), 1e-300)


def fit_vector_reduction(df: DataFrame, x: str, k: int) -> VectorReduction:
    z = G.design(df.withColumn("__c", F.lit(0)), F.col(x), [], ["__c"])
    g = G.grams(z, ["__c"], 0)
    mo = G.moments(g.total, g.p, g.centre)
    a, _ = mo.standardized()
    axes, share = principal_axes(a, int(min(k, mo.n, mo.p)))
    raw = axes / mo.sd[None, :]
    return VectorReduction(np.column_stack([-raw @ mo.mean[: mo.p], raw]), share)


@dataclass(frozen=True)
class Kernels:
    """Random dilated convolution kernels: drawn from the seed and the series length, never from data."""

    weights: tuple[np.ndarray, ...]
    biases: np.ndarray
    dilations: tuple[int, ...]
    padded: tuple[bool, ...]

    @staticmethod
    def draw(length: int, count: int, seed: int = 0) -> Kernels:
        """Kernels of 7, 9 or 11 centred normal weights, dilations spread evenly over the scales that fit."""
        rng = np.random.default_rng([seed, length])
        sizes = [min(int(s), length) for s in rng.choice([7, 9, 11], count)]
        weights = [rng.normal(size=s) for s in sizes]
        room = [np.log2(max(1.0, (length - 1) / max(1, s - 1))) for s in sizes]
        return Kernels(
            tuple(w - w.mean() for w in weights), rng.uniform(-1, 1, count),
            tuple(int(2 ** rng.uniform(0, r)) for r in room), tuple(bool(b) for b in rng.integers(0, 2, count)))

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        """(rows x length) -> for every kernel the share of positive responses and the largest response."""
        out = np.empty((len(rows), 2 * len(self.weights)))
        for i, (w, bias, step, padded) in enumerate(zip(self.weights, self.biases, self.dilations, self.padded, strict=True)):
            reach = (len(w) - 1) * step
            edge = reach // 2 if padded else 0
            wide = np.pad(rows, ((0, 0), (edge, edge)))
            span = wide.shape[1] - reach
            response = np.full((len(rows), span), bias)
            for j, v in enumerate(w):
                response += v * wide[:, j * step:j * step + span]
            out[:, 2 * i], out[:, 2 * i + 1] = (response > 0).mean(axis=1), response.max(axis=1)
        return out


EMBED_ROWS = 256


def series_embedding(
    resampled: DataFrame, length: int = LENGTH, kernels: int = 64, seed: int = 0, scorer: Callable[[np.ndarray], np.ndarray] | None = None,
    k: int | None = None,
) -> DataFrame:
    """Deterministic subject vectors ``ts0..``: z-scored series of ``length`` points under random kernels.

    Nothing is learned: a subject's vector depends on its own series only.  ``scorer`` may
    replace the kernels by any (rows x length) -> (rows x k) model, applied to Arrow batches.
    """
    apply, width = (Kernels.draw(length, kernels, seed), 2 * kernels) if scorer is None else (scorer, int(k))
    names = [f"ts{i}" for i in range(width)]
    vectors = as_vectors(resampled)
    kind = dict(vectors.dtypes)["subject_id"]

    def scaled(rows: np.ndarray) -> np.ndarray:  # in the order of time, so that reruns agree to the last digit
        spread = rows.std(axis=1, keepdims=True)
        return np.where(spread > 0, (rows - rows.mean(axis=1, keepdims=True)) / np.where(spread > 0, spread, 1), 0.0)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), EMBED_ROWS):
                some = pdf.iloc[at:at + EMBED_ROWS]
                out = pd.DataFrame(np.asarray(apply(scaled(np.stack(some["x"].to_numpy()))), dtype=float), columns=names)
                out.insert(0, "subject_id", some["subject_id"].to_numpy())
                yield out

    return vectors.mapInPandas(score, f"subject_id {kind}, " + ", ".join(f"{c} double" for c in names))
