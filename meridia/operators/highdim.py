"""Reduction of wide, holed feature tables kept in long form (subject_id, analyte, value).

Missing cells need no rows: after median imputation a standardized value is the
feature's base plus a deviation that is zero where the cell is missing, so every
cross product below is a sum over present cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.operators import gram as G
from meridia.operators.clean import impute, medians
from meridia.operators.metrics import regression_metrics
from meridia.operators.models import (
    FIT_THREADS, RIDGE_ALPHAS, fold_grams, ridge_loo_errors, score_folds, train_moments, tree_model, with_features,
)
from meridia.operators.ordered import ordered
from meridia.session import durable

BLOCK = 256
#: Columns whose mutual edges one task scans.
RANGE = 2048
MIN_VARIANCE = 1e-8


def prevalence(cells: DataFrame, n_subjects: int) -> DataFrame:
    present = F.count("value") / F.lit(float(n_subjects))
    return cells.groupBy("analyte").agg((1.0 - present).alias("missing_fraction"))


def prevalence_filter(cells: DataFrame, max_missing: float = 0.5) -> DataFrame:
    n = cells.agg(F.countDistinct("subject_id")).first()[0]
    kept = prevalence(cells, n).where(F.col("missing_fraction") <= max_missing).select("analyte")
    return cells.join(kept, "analyte", "left_semi")


def variance_filter(cells: DataFrame, min_var: float = MIN_VARIANCE) -> DataFrame:
    kept = cells.groupBy("analyte").agg(F.var_samp("value").alias("v")).where(F.col("v") > min_var).select("analyte")
    return cells.join(kept, "analyte", "left_semi")


def feature_stats(cells: DataFrame, n: int, order: DataFrame | None = None) -> DataFrame:
    """Per analyte: column index, median, mean and population sd after imputation, base.

    Columns stand in the order of ``order`` (analyte, ordinal), by name where it says nothing.
    """
    med = medians(cells)
    v, m = F.col("value"), F.col("median")
    joined = cells.where(v.isNotNull()).join(med, "analyte")
    d = v - m
    stats = joined.groupBy("analyte").agg(
        F.max("median").alias("median"), F.sum(d).alias("sd1"), F.sum(d * d).alias("sd2"))
    shift = F.col("sd1") / F.lit(float(n))
    var = F.col("sd2") / F.lit(float(n)) - shift * shift
    sd = F.sqrt(F.greatest(var, F.lit(0.0)))
    stats = stats.select("analyte", "median", (F.col("median") + shift).alias("mean"),
                         F.when(sd > 0, sd).otherwise(1.0).alias("sd"))
    if order is not None:
        stats = stats.join(order.select("analyte", "ordinal"), "analyte", "left")
    placed = ordered(stats, [], ["analyte"] if order is None else ["ordinal", "analyte"], pos="idx").drop("ordinal")
    return placed.withColumn("idx", F.col("idx") - 1).withColumn("base", (F.col("median") - F.col("mean")) / F.col("sd"))


def block_products(cells: DataFrame, stats: DataFrame, block: int = BLOCK) -> DataFrame:
    """Sums of products of deviations for pairs of feature blocks: b1 <= b2, v (block x block, flat)."""
    kind = dict(cells.dtypes)["subject_id"]
    scaled = cells.where(F.col("value").isNotNull()).join(stats.select("analyte", "idx", "median", "sd"), "analyte").select(
        "subject_id", F.floor(F.col("idx") / block).cast("int").alias("b"), F.pmod("idx", F.lit(block)).cast("int").alias("i"),
        ((F.col("value") - F.col("median")) / F.col("sd")).alias("d"))
    # at most one value per feature of the block
    packed = scaled.groupBy("subject_id", "b").agg(F.collect_list(F.struct("i", "d")).alias("c")).select(
        "subject_id", "b", F.col("c.i").alias("i"), F.col("c.d").alias("d"))

    def dense(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (b.iloc[at:at + G.ROWS] for b in batches for at in range(0, len(b), G.ROWS)):
            z = np.zeros((len(pdf), block))
            if len(pdf):
                rows = np.repeat(np.arange(len(pdf)), [len(i) for i in pdf["i"]])
                z[rows, np.concatenate(list(pdf["i"]))] = np.concatenate(list(pdf["d"]))
            yield pd.DataFrame({"subject_id": pdf["subject_id"], "b": pdf["b"], "z": list(z)})

    rows = packed.mapInPandas(dense, f"subject_id {kind}, b int, z array<double>")
    right = rows.select("subject_id", F.col("b").alias("b2"), F.col("z").alias("z2"))
    pairs = rows.join(right, "subject_id").where(F.col("b") <= F.col("b2")).select(
        F.col("b").alias("b1"), "b2", F.concat("z", "z2").alias("z"))
    part = G.summed(pairs, ["b1", "b2"], lambda z: (z[:, :block].T @ z[:, block:]).ravel())
    return part.repartition("b1", "b2").mapInPandas(
        lambda it: G._merge(it, ["b1", "b2"]), "b1 int, b2 int, v array<double>")


def correlation_pairs(products: DataFrame, base: np.ndarray, n: int, above: float = -1.0, block: int = BLOCK) -> DataFrame:
    """Feature pairs a < b (column indexes) with absolute correlation above a threshold."""

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for b1, b2, v in zip(pdf["b1"], pdf["b2"], pdf["v"]):
                x, y = base[b1 * block:(b1 + 1) * block], base[b2 * block:(b2 + 1) * block]
                r = np.abs(np.asarray(v).reshape(block, block)[: len(x), : len(y)] / n - np.outer(x, y))
                r = np.nan_to_num(r)
                i, j = np.nonzero(r > above)
                a, b = i + b1 * block, j + b2 * block
                ok = a < b
                yield pd.DataFrame({"a": a[ok], "b": b[ok], "r": r[i[ok], j[ok]]})

    return products.mapInPandas(edges, "a bigint, b bigint, r double")


def base_values(stats: DataFrame) -> np.ndarray:
    """Base of every feature by column index: one number per feature."""
    rows = stats.select("idx", "base").collect()
    out = np.zeros(len(rows))
    for row in rows:
        out[row["idx"]] = row["base"]
    return out


def greedy_drop(edges: DataFrame, width: int = RANGE) -> DataFrame:
    """Features dropped by the ordered first-keep rule, from the edges a < b.

    Columns are taken in ranges of ``width`` in their order: one job a range, whatever the
    edges look like.  Its tasks leave out edges from dropped columns and reduce those from
    earlier survivors to the columns they drop; one task then scans the edges inside the
    range, width**2 / 2 at most.  A dropped column is one number on the driver.
    """
    spark = edges.sparkSession
    at = F.floor(F.col("b") / width).cast("int").alias("r")
    live = durable(edges.select("a", "b", at).repartitionByRange("r").sortWithinPartitions("r"), "edges")
    dropped = np.zeros(0, np.int64)
    for r in sorted(row["r"] for row in live.select("r").distinct().collect()):
        gone, first = dropped, r * width

        def reduce_task(batches: Iterator[pd.DataFrame], gone=gone, first=first) -> Iterator[pd.DataFrame]:
            hit: set[int] = set()
            for pdf in batches:
                some = pdf[~np.isin(pdf["a"].to_numpy(), gone)]
                inside = some["a"].to_numpy() >= first
                hit.update(some["b"].to_numpy()[~inside].tolist())
                yield some[inside][["a", "b"]]
            yield pd.DataFrame({"a": np.full(len(hit), -1, np.int64), "b": np.fromiter(hit, np.int64, len(hit))})

        def scan(batches: Iterator[pd.DataFrame], first=first) -> Iterator[pd.DataFrame]:
            parts = [pdf.to_numpy(np.int64) for pdf in batches if len(pdf)]
            pairs = np.concatenate(parts) if parts else np.zeros((0, 2), np.int64)
            out = np.zeros(width, bool)
            out[pairs[pairs[:, 0] < 0, 1] - first] = True
            inside = pairs[pairs[:, 0] >= 0]
            inside = inside[np.argsort(inside[:, 0], kind="stable")] - first
            starts = np.flatnonzero(np.diff(inside[:, 0], prepend=-1))
            for rows in np.split(inside, starts[1:]) if len(inside) else []:
                if not out[rows[0, 0]]:
                    out[rows[:, 1]] = True
            yield pd.DataFrame({"idx": np.flatnonzero(out) + first})

        pairs = live.where(F.col("r") == r).select("a", "b").mapInPandas(reduce_task, "a bigint, b bigint")
        found = pairs.repartition(1).mapInPandas(scan, "idx bigint").collect()
        dropped = np.concatenate([dropped, np.array([row["idx"] for row in found], np.int64)])
    return spark.createDataFrame([(int(i),) for i in dropped], "idx bigint")


def correlation_prune(cells: DataFrame, threshold: float = 0.95, order: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) analytes; earlier columns win (``order``: analyte, ordinal; by name without it)."""
    n = cells.agg(F.countDistinct("subject_id")).first()[0]
    stats = durable(feature_stats(cells, n, order), "stats")
    gone = greedy_drop(correlation_pairs(block_products(cells, stats), base_values(stats), n, threshold))
    return stats.join(gone, "idx", "left_anti").select("analyte"), stats.join(gone, "idx", "left_semi").select("analyte")


@dataclass
class Reducer:
    """Everything learned on train rows: params (analyte, median, sd, loading) and the base score."""

    params: DataFrame
    base: np.ndarray
    trace: dict
    explained: np.ndarray

    def apply(self, cells: DataFrame, prefix: str = "omics_pc") -> DataFrame:
        """Scores per subject; unknown analytes are ignored, absent ones count as their median."""
        d = (F.col("value") - F.col("median")) / F.col("sd")
        long = cells.join(self.params, "analyte", "left").select(
            "subject_id", F.coalesce(d, F.lit(0.0)).alias("d"),
            F.coalesce("loading", F.array(*[F.lit(0.0)] * len(self.base))).alias("loading"))
        sums = long.groupBy("subject_id").agg(*[
            (F.sum(F.col("d") * F.col("loading")[i]) + float(b)).alias(f"{prefix}{i}") for i, b in enumerate(self.base)])
        return sums

    def trace_frame(self) -> DataFrame:
        spark = self.params.sparkSession
        return spark.createDataFrame([(i, k, float(v)) for i, (k, v) in enumerate(self.trace.items())],
                                     "step int, name string, value double")


def fit_reduction(
    cells: DataFrame, max_missing: float = 0.5, threshold: float = 0.95, k: int = 20, order: DataFrame | None = None) -> Reducer:
    """Prevalence, variance, median imputation, correlation prune and principal components of train cells."""
    n, start = cells.agg(F.countDistinct("subject_id"), F.countDistinct("analyte")).first()
    table = durable(cells.groupBy("analyte").agg(F.count("value").alias("m"), F.var_samp("value").alias("v")), "features")
    common = 1.0 - F.col("m") / F.lit(float(n)) <= max_missing
    good = common & (F.col("v") > MIN_VARIANCE)
    after_prev, after_var = table.agg(F.count_if(common), F.count_if(good)).first()
    if not after_var:
        raise ValueError("no feature passes the prevalence and variance filters")
    kept = durable(cells.join(table.where(good).select("analyte"), "analyte", "left_semi"), "kept")
    stats = durable(feature_stats(kept, n, order), "stats")
    base = base_values(stats)
    products = durable(block_products(kept, stats), "products")
    gone = durable(greedy_drop(correlation_pairs(products, base, n, threshold)), "gone")
    lean = stats.join(gone, "idx", "left_anti")
    keep = np.array(sorted(row["idx"] for row in lean.select("idx").collect()))
    p = len(keep)
    k = int(min(k, n, p))
    loadings, share = components(products, keep, n, base, k)
    params = durable(lean.join(loadings, "idx").select("analyte", "median", "sd", "base", "loading"), "params")
    zero = params.select([F.sum(F.col("base") * F.col("loading")[i]) for i in range(k)]).first()
    trace = {
        "n_train": n, "start_analytes": start, "after_prevalence": after_prev, "after_variance": after_var,
        "correlation_dropped": after_var - p, "after_correlation_prune": p, "n_pca_components": k,
        "pca_variance_explained": float(np.sum(share)),
    }
    return Reducer(params.drop("base"), np.array([float(v) for v in zero]), trace, share)


def panel_product(products: DataFrame, panel: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The symmetric matrix of :func:`block_products` times a thin panel (features x columns): one aggregate.

    Every task adds its blocks to the rows of the result they touch; rows are merged per block.
    """
    width = panel.shape[1]

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for b1, b2, v in zip(pdf["b1"], pdf["b2"], pdf["v"], strict=True):
                m = np.asarray(v).reshape(block, block)
                for to, part, at in ((b1, m, b2), (b2, m.T, b1))[: 1 if b1 == b2 else 2]:
                    rows = panel[at * block:(at + 1) * block]
                    sums[to] = sums.get(to, 0.0) + part[:, : len(rows)] @ rows
        if sums:
            yield pd.DataFrame({"b": list(sums), "v": [s.ravel() for s in sums.values()]})

    parts = products.mapInPandas(local, "b int, v array<double>").repartition("b")
    out = np.zeros_like(panel)
    for row in parts.mapInPandas(lambda it: G._merge(it, ["b"]), "b int, v array<double>").toLocalIterator():
        rows = np.asarray(row["v"]).reshape(block, width)
        at = row["b"] * block
        out[at:at + block] += rows[: len(out) - at]
    return out


def _orthonormal(fresh: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Columns that extend an orthonormal basis; what the basis already spans is left out."""
    for _ in range(2):
        fresh = fresh - basis @ (basis.T @ fresh)
        norms = np.linalg.norm(fresh, axis=0)
        fresh = fresh[:, norms > 1e-10] / norms[norms > 1e-10]
        u, size, _ = np.linalg.svd(fresh, full_matrices=False)
        fresh = u[:, size > 1e-8]
    return fresh


def leading_axes(times, p: int, k: int, extra: int = 8, widest: int = 12, tol: float = 1e-9, most: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """(axes as rows, eigenvalues) of the k largest of a symmetric matrix known by its product with a panel.

    Block subspace iteration that keeps what it has seen: the residuals of the best
    approximations extend an orthonormal basis, whose small projected matrix gives the next
    approximations.  A basis of ``widest`` blocks is cut back to the best two.  Raises if
    the residuals are not below ``tol`` of the largest eigenvalue after ``most`` products.
    """
    size = min(p, k + extra)
    basis = _orthonormal(np.random.default_rng(0).normal(size=(p, size)), np.zeros((p, 0)))
    image = times(basis)
    for _ in range(most):
        small = basis.T @ image
        lam, vec = np.linalg.eigh((small + small.T) / 2)
        best = np.argsort(lam)[::-1]
        top, weights = lam[best[:size]], vec[:, best[:size]]
        residual = image @ weights - (basis @ weights) * top
        open_ = np.linalg.norm(residual, axis=0) > tol * max(abs(top[0]), 1e-300)
        if not open_[:k].any():
            break
        if basis.shape[1] + size > widest * size:
            keep = vec[:, best[: 2 * size]]
            basis, image = basis @ keep, image @ keep
        fresh = _orthonormal(residual[:, open_], basis)
        if not fresh.shape[1]:
            break
        basis, image = np.hstack([basis, fresh]), np.hstack([image, times(fresh)])
    else:
        raise ValueError(f"components not found within {most} products")
    axes = (basis @ weights[:, :k]).T
    flip = np.sign(axes[np.arange(k), np.argmax(np.abs(axes), axis=1)])
    return axes * flip[:, None], top[:k]


def components(products: DataFrame, keep: np.ndarray, n: int, base: np.ndarray, k: int) -> tuple[DataFrame, np.ndarray]:
    """Loadings (idx, loading) of the first k components of the kept features, and their shares of the variance.

    The driver holds panels of p x k numbers; the p x p products stay in their blocks.
    """
    b = base[keep]

    def times(panel: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(base), panel.shape[1]))
        wide[keep] = panel
        return panel_product(products, wide)[keep] / n - np.outer(b, b @ panel)

    axes, lam = leading_axes(times, len(keep), k)
    at = F.expr(f"transform(sequence(0, {BLOCK - 1}), i -> v[i * {BLOCK} + i])")
    diagonal = products.where("b1 = b2").select("b1", F.posexplode(at).alias("i", "d")).select(
        (F.col("b1") * BLOCK + F.col("i")).cast("bigint").alias("idx"), "d")
    kept = products.sparkSession.createDataFrame(
        [(int(i), [float(v) for v in axes[:, pos]]) for pos, i in enumerate(keep)], "idx bigint, loading array<double>")
    trace = diagonal.join(kept.select("idx"), "idx").agg(F.sum("d")).first()[0] / n - b @ b
    return kept, np.clip(lam, 0, None) / max(trace, 1e-300)


@dataclass
class Reduced:
    """A wide table made compact, for reports (learned on all rows): long cells, scores, shares and the trace."""

    cells: DataFrame
    scores: DataFrame
    explained: np.ndarray
    trace: DataFrame


def highdim_pipeline(cells: DataFrame, max_missing: float = 0.5, threshold: float = 0.95, k: int = 20) -> Reduced:
    """Every reduction step on all rows: the full grid of surviving analytes and the component scores per subject."""
    fitted = fit_reduction(cells, max_missing, threshold, k)
    lean = cells.join(fitted.params.select("analyte"), "analyte", "left_semi")
    grid = impute(cells.select("subject_id").distinct().join(lean, "subject_id", "left"), fitted.params.select("analyte", "median"))
    return Reduced(grid, fitted.apply(cells), fitted.explained, fitted.trace_frame())


def highdim_cv(cells: DataFrame, labels: DataFrame, fold: str, leak: bool = False, k: int = 20,
               max_missing: float = 0.5, threshold: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """(out-of-fold predictions of both models, fold trace) of reduction + ridge and reduction + boosted trees.

    Honest: the reduction is learned per fold on its train rows; leaky: once on all
    rows.  ``labels`` holds subject_id, y and the fold column.
    """
    missing = labels.join(cells.select("subject_id").distinct(), "subject_id", "left_anti")
    if not missing.isEmpty():
        raise ValueError("every labelled subject needs feature cells")
    folds = [row[0] for row in labels.select(fold).distinct().orderBy(fold).collect()]
    shared = fit_reduction(cells, max_missing, threshold, k) if leak else None

    def one_fold(f) -> tuple[DataFrame, tuple, list[str]]:
        train = labels.where(F.col(fold) != f)
        reducer = shared or fit_reduction(cells.join(train, "subject_id", "left_semi"), max_missing, threshold, k)
        names = [f"omics_pc{i}" for i in range(len(reducer.base))]
        scored = durable(reducer.apply(cells).join(labels, "subject_id").select(
            "subject_id", "y", (F.col(fold) == f).cast("int").alias("held"), F.array(*names).alias("x")), "scores")
        g = fold_grams(scored, "x", ["y"], "held")
        errs = ridge_loo_errors(scored, "x", "y", "held", g, folds=[1])
        alpha = float(RIDGE_ALPHAS[int(np.argmin(errs[1]))])
        coef = {1: G.ridge(train_moments(g, 1), alpha)[:, 0]}
        part = score_folds(scored.where("held = 1"), "x", "held", coef, ["subject_id", F.col("y").alias("y_true")])
        trees = durable(with_features(scored, "x").select("subject_id", F.col("y").cast("double").alias("label"), "features", "held"), "trees")
        boosted = tree_model("boosted").fit(trees.where("held = 0")).transform(trees.where("held = 1")).select(
            "subject_id", F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"))
        part = part.withColumn("model", F.lit("ridge")).unionByName(boosted.withColumn("model", F.lit("boosted")))
        return part.withColumn("fold", F.lit(f)), (int(f), alpha, *map(float, reducer.trace.values())), list(reducer.trace)

    with ThreadPool(min(FIT_THREADS, len(folds))) as pool:  # folds are independent Spark jobs
        parts = pool.map(one_fold, folds)
    preds = reduce(DataFrame.unionByName, [part for part, _, _ in parts])
    columns = "fold int, alpha double, " + ", ".join(f"{c} double" for c in parts[0][2])
    return preds, cells.sparkSession.createDataFrame([t for _, t, _ in parts], columns)


def optimism_gap(cells: DataFrame, labels: DataFrame, fold: str, **kw) -> DataFrame:
    """Per model three rows: honest, leaky, and leaky minus honest."""
    parts = [highdim_cv(cells, labels, fold, leak, **kw)[0].withColumn("variant", F.lit(name)) for name, leak in (("honest", False), ("leaky", True))]
    scores = durable(regression_metrics(durable(parts[0].unionByName(parts[1]), "preds"), "y_true", "y_pred", ["model", "variant"]), "scores")
    names = [c for c in scores.columns if c not in ("model", "variant")]
    sign = F.when(F.col("variant") == "leaky", 1.0).otherwise(-1.0)
    gap = scores.groupBy("model").agg(*[F.sum(sign * F.col(c)).alias(c) for c in names]).withColumn("variant", F.lit("gap"))
    return scores.unionByName(gap)
