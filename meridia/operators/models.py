"""Fold assignment and cross-validated models."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.operators import gram as G
from meridia.operators.ordered import ordered
from meridia.session import durable

# The penalty grids of the ridge and elastic-net models.
RIDGE_ALPHAS = np.logspace(-3, 3, 25)
EN_ALPHAS = np.logspace(-3, 1, 20)
EN_L1 = np.array([0.1, 0.3, 0.5, 0.7, 0.9, 1.0])

FIT_THREADS = 5


# ---- folds

def hash_fold(key: Column | str, k: int, seed: int = 0) -> Column:
    """Shuffled K-fold by hash of the row key: no sort, independent of partitioning."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(k)).cast("int")


def assign_folds(df: DataFrame, key: str, mode: str = "loo", *, group: str | None = None, k: int = 5, seed: int = 0) -> DataFrame:
    """Adds ``fold``: 'loo' one per row, 'group' one per group value, 'kfold' shuffled and equal-sized."""
    if mode == "loo":
        return ordered(df, [], [key], pos="fold").withColumn("fold", F.col("fold") - 1)
    if mode == "group":
        ids = ordered(df.select(group).distinct(), [], [group], pos="fold")
        return df.join(ids.withColumn("fold", F.col("fold") - 1), group)
    if mode == "kfold":
        mixed = df.withColumn("__h", F.xxhash64(key, F.lit(seed)))
        return ordered(mixed, [], ["__h", key], pos="fold").withColumn(
            "fold", F.pmod(F.col("fold") - 1, F.lit(k))
        ).drop("__h")
    raise ValueError(f"unknown fold mode {mode!r}")


# ---- linear models from fold matrices

def dot(x: Column, coef: Column) -> Column:
    """[intercept, b...] . [1, x...] as a native expression."""
    return F.aggregate(
        F.zip_with(x, F.slice(coef, F.lit(2), F.size(x)), lambda a, b: a * b), F.element_at(coef, 1), lambda s, v: s + v
    )


def fold_grams(df: DataFrame, x: str, ys: list[str], fold: str = "fold", more: tuple[str, ...] = ()) -> G.Grams:
    z = G.design(df, F.col(x), [F.col(y) for y in ys], [fold, *more])
    return G.grams(z, [fold, *more], len(ys))


def _fold_of(cell):
    return cell[0] if isinstance(cell, tuple) else cell


def train_moments(g: G.Grams, fold) -> G.Moments:
    return G.moments(g.without(lambda c: _fold_of(c) == fold), g.p, g.centre)


def score_folds(df: DataFrame, x: str, fold: str, coefs: dict, keep: list[str], name: str = "y_pred") -> DataFrame:
    """Held-out predictions: each row meets the coefficients of its own fold."""
    spark = df.sparkSession
    rows = [(f, [float(v) for v in c]) for f, c in coefs.items()]
    kind = dict(df.dtypes)[fold]
    table = spark.createDataFrame(rows, f"{fold} {kind}, coef array<double>")
    wide = F.transform(F.col(x), lambda v: v.cast("double"))
    return df.join(table, fold).select(*keep, dot(wide, F.col("coef")).alias(name))


def linear_cv(df: DataFrame, key: str, x: str, y: str, fold: str = "fold", alpha: float = 0.0) -> DataFrame:
    """Out-of-fold predictions of least squares (alpha 0) or ridge, standardized on train rows only."""
    g = fold_grams(df, x, [y], fold)
    coefs = {f: G.ridge(train_moments(g, f), alpha)[:, 0] for f in g.cells}
    return score_folds(df, x, fold, coefs, [key, fold, F.col(y).cast("double").alias("y_true")])


def loo_closed_form(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Leave-one-out least-squares predictions from the hat values: key, y_true, y_pred, h."""
    g = fold_grams(df.withColumn("fold", F.lit(0)), x, [y])
    total = g.total
    inv = np.linalg.pinv(total[: g.p + 1, : g.p + 1], rcond=1e-12, hermitian=True)
    beta = inv @ total[: g.p + 1, g.p + 1]
    centre, p = g.centre, g.p

    def leverage(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            z = np.column_stack([np.ones(len(pdf)), np.stack(pdf["x"].to_numpy()).astype(float) - centre[1: p + 1]])
            h = np.clip(np.einsum("ij,jk,ik->i", z, inv, z), 0, 1 - 1e-12)
            yc = pdf["y_true"].to_numpy(float)
            resid = (yc - centre[p + 1] - z @ beta) / (1 - h)
            yield pd.DataFrame({"k": pdf["k"], "y_true": yc, "y_pred": yc - resid, "h": h})

    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("k"), F.col(x).alias("x"), F.col(y).cast("double").alias("y_true"))
    out = rows.mapInPandas(leverage, f"k {kind}, y_true double, y_pred double, h double")
    return out.withColumnRenamed("k", key)


def ridge_loo(df: DataFrame, key: str, x: str, y: str, alpha: float) -> DataFrame:
    """Leave-one-out ridge predictions in closed form: key, y_true, y_pred, h.

    The penalty weighs each raw coefficient by the spread of its feature over all rows
    (labels take no part in it); given that, a row's prediction is exactly that of a fit
    without the row, intercept included.
    """
    g = fold_grams(df.withColumn("fold", F.lit(0)), x, [y])
    mo = G.moments(g.total, g.p, g.centre)
    a, b = mo.standardized()
    lam, vec = np.linalg.eigh(a)
    shrink = 1.0 / (np.clip(lam, 0, None) + alpha / mo.n)
    axis_beta, mean, sd, n, p = shrink * (vec.T @ b[:, 0]), mo.mean, mo.sd, mo.n, mo.p

    def leave_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            t = ((np.stack(pdf["x"].to_numpy()).astype(float) - mean[:p]) / sd) @ vec
            h = np.clip((1.0 + (t * t) @ shrink) / n, 0, 1 - 1e-12)
            ys = pdf["y_true"].to_numpy(float)
            resid = (ys - mean[p] - t @ axis_beta) / (1 - h)
            yield pd.DataFrame({"k": pdf["k"], "y_true": ys, "y_pred": ys - resid, "h": h})

    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("k"), F.col(x).alias("x"), F.col(y).cast("double").alias("y_true"))
    return rows.mapInPandas(leave_out, f"k {kind}, y_true double, y_pred double, h double").withColumnRenamed("k", key)


def r2(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    res = F.col(y) - F.col(p)
    return df.agg((1.0 - F.try_divide(F.avg(res * res), F.var_pop(y))).alias("R2"), F.count(F.lit(1)).alias("n"))


# ---- ridge with the penalty chosen by leave-one-out error on the training rows

def ridge_loo_errors(
    df: DataFrame, x: str, y: str, fold: str, g: G.Grams, use: dict | None = None, alphas: np.ndarray = RIDGE_ALPHAS,
    folds: list | None = None,
) -> dict:
    """Per outer fold: summed squared leave-one-out error of each alpha over that fold's training rows.

    All folds and alphas are scored in one pass; standardization is fixed per training set.
    """
    plans = {}
    for f in g.cells if folds is None else folds:
        mo = train_moments(g, f)
        idx = np.arange(mo.p) if use is None else np.asarray(use[f], dtype=int)
        a, b = mo.standardized()
        lam, vec = np.linalg.eigh(a[np.ix_(idx, idx)])
        lam = np.clip(lam, 0, None)
        plans[f] = (idx, mo.mean, mo.sd, lam, vec, vec.T @ b[idx, 0], mo.n, mo.p)
    n_alpha = len(alphas)

    def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for pdf in batches:
            raw = np.stack(pdf["x"].to_numpy()).astype(float)
            ys, own = pdf["y"].to_numpy(float), pdf["fold"].to_numpy()
            for f, (idx, mean, sd, lam, vec, vb, n, p) in plans.items():
                rows = own != f
                if not rows.any():
                    continue
                t = ((raw[rows][:, idx] - mean[idx]) / sd[idx]) @ vec
                part = np.empty(n_alpha)
                for i, alpha in enumerate(alphas):
                    d = 1.0 / (lam + alpha / n)
                    h = 1.0 / n + (t * t) @ d / n
                    e = ys[rows] - mean[p] - t @ (d * vb)
                    part[i] = np.sum((e / (1.0 - np.clip(h, 0, 1 - 1e-12))) ** 2)
                sums[f] = sums.get(f, 0.0) + part
        if sums:
            yield pd.DataFrame({"f": list(sums), "sse": [list(map(float, v)) for v in sums.values()]})

    kind = dict(df.dtypes)[fold]
    parts = df.select(F.col(x).alias("x"), F.col(y).cast("double").alias("y"), F.col(fold).alias("fold")).mapInPandas(
        errors, f"f {kind}, sse array<double>"
    )
    merged = parts.select("f", F.posexplode("sse").alias("i", "e")).groupBy("f", "i").agg(F.sum("e").alias("e"))
    got = {f: np.full(n_alpha, np.inf) for f in plans}
    for row in merged.collect():  # folds x alphas
        got[row["f"]][row["i"]] = row["e"]
    return got


def ridge_path_cv(df: DataFrame, key: str, x: str, y: str, fold: str = "fold") -> tuple[DataFrame, dict]:
    """Out-of-fold ridge predictions, alpha per fold by leave-one-out error; also alpha by fold."""
    g = fold_grams(df, x, [y], fold)
    errs = ridge_loo_errors(df, x, y, fold, g)
    chosen = {f: float(RIDGE_ALPHAS[int(np.argmin(e))]) for f, e in errs.items()}
    coefs = {f: G.ridge(train_moments(g, f), chosen[f])[:, 0] for f in g.cells}
    return score_folds(df, x, fold, coefs, [key, fold, F.col(y).cast("double").alias("y_true")]), chosen


# ---- elastic net: penalty by inner folds, on the matrices of (outer, inner) cells

def _en_grid(alphas: np.ndarray, l1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, r = np.meshgrid(alphas, l1)
    return a.ravel(), r.ravel()


def elastic_net_fold(g: G.Grams, fold, use: np.ndarray | None = None, l1: np.ndarray = EN_L1) -> tuple[np.ndarray, float, float]:
    """Refit coefficients and the (alpha, l1) with the least inner held-out error; cells are (outer, inner)."""
    a, r = _en_grid(EN_ALPHAS, l1)
    inner = sorted({c[1] for c in g.cells})
    sums = np.zeros((6, len(a)))
    for i in inner:
        train = g.without(lambda c: c[0] == fold or c[1] == i)
        valid = [m for c, m in g.cells.items() if c[0] != fold and c[1] == i]
        if not valid:
            continue
        coef = G.elastic_net(G.moments(train, g.p, g.centre), a, r, use)
        sums += G.held_out(sum(valid), g.centre, g.p, coef, 0)
    best = int(np.argmin(sums[3] - 2 * sums[5] + sums[4]))
    coef = G.elastic_net(train_moments(g, fold), a[best: best + 1], r[best: best + 1], use)
    return coef[:, 0], float(a[best]), float(r[best])


def elasticnet_cv(df: DataFrame, key: str, x: str, y: str, fold: str = "fold", inner: str = "inner") -> tuple[DataFrame, dict]:
    g = fold_grams(df, x, [y], fold, (inner,))
    fits = {f: elastic_net_fold(g, f) for f in sorted({c[0] for c in g.cells})}
    preds = score_folds(df, x, fold, {f: v[0] for f, v in fits.items()}, [key, fold, F.col(y).cast("double").alias("y_true")])
    return preds, {f: (v[1], v[2]) for f, v in fits.items()}


# ---- tuned linear model on nested cells, everything from matrices

def nested_ridge(g: G.Grams, alphas: np.ndarray = RIDGE_ALPHAS, nested: bool = True, label: int = 0) -> tuple[dict, dict]:
    """Pooled held-out scores with alpha tuned inside each outer fold, or once on all rows."""
    outer = sorted({c[0] for c in g.cells})
    inner = sorted({c[1] for c in g.cells})

    def tune(skip) -> float:
        sums = np.zeros((6, len(alphas)))
        for i in inner:
            train = g.without(lambda c: c[0] == skip or c[1] == i)
            valid = [m for c, m in g.cells.items() if c[0] != skip and c[1] == i]
            if valid:
                mo = G.moments(train, g.p, g.centre)
                coef = np.column_stack([G.ridge(mo, a)[:, label] for a in alphas])
                sums += G.held_out(sum(valid), g.centre, g.p, coef, label)
        return float(alphas[int(np.argmin(sums[3] - 2 * sums[5] + sums[4]))])

    once = None if nested else tune(object())
    chosen, pooled = {}, np.zeros((6, 1))
    for f in outer:
        chosen[f] = tune(f) if nested else once
        coef = G.ridge(train_moments(g, f), chosen[f])[:, label: label + 1]
        pooled += G.held_out(sum(m for c, m in g.cells.items() if c[0] == f), g.centre, g.p, coef, label)
    return {k: float(v[0]) for k, v in G.pooled_scores(pooled).items()}, chosen


# ---- tree ensembles (Spark ML)

def with_features(df: DataFrame, x: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.transform(F.col(x), lambda v: v.cast("double"))))


def tree_model(kind: str, task: str = "regression", label: str = "label", **params):
    """'forest' or 'boosted' estimator with light defaults, overridable."""
    if kind == "forest":
        cls = RandomForestRegressor if task == "regression" else RandomForestClassifier
        base = {"numTrees": 50, "maxDepth": 4, "seed": 0}
    elif kind == "boosted":
        cls = GBTRegressor if task == "regression" else GBTClassifier
        base = {"maxIter": 20, "maxDepth": 3, "stepSize": 0.1, "subsamplingRate": 0.8, "seed": 0}
    else:
        raise ValueError(f"unknown tree model {kind!r}")
    return cls(featuresCol="features", labelCol=label, **{**base, **params})


def tree_cv(df: DataFrame, key: str, x: str, y: str, fold: str = "fold", kind: str = "forest", **params) -> DataFrame:
    """Out-of-fold predictions of a tree ensemble: one distributed fit per fold, all rows kept in Spark."""
    rows = durable(with_features(df, x).select(key, fold, F.col(y).cast("double").alias("label"), "features"), "trees")
    folds = [row[0] for row in rows.select(fold).distinct().orderBy(fold).collect()]

    def held_out_rows(f) -> DataFrame:
        model = tree_model(kind, **params).fit(rows.where(F.col(fold) != f))
        return model.transform(rows.where(F.col(fold) == f)).select(
            key, fold, F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"))

    with ThreadPool(min(FIT_THREADS, len(folds))) as pool:  # the fits are separate Spark jobs
        parts = pool.map(held_out_rows, folds)
    return reduce(DataFrame.unionByName, parts)


def grid_search(df: DataFrame, x: str, y: str, grid: dict[str, list], kind: str = "boosted", task: str = "regression",
                key: str = "key", folds: int = 5, seed: int = 0):
    """Fitted CrossValidator over the grid with fixed shuffled folds; scored by MSE or accuracy."""
    est = tree_model(kind, task)
    built = ParamGridBuilder()
    for name, values in grid.items():
        built = built.addGrid(est.getParam(name), values)
    rows = durable(with_features(df, x).select(
        F.col(y).cast("double").alias("label"), "features", hash_fold(key, folds, seed).alias("cv_fold")), "grid")
    judge = RegressionEvaluator(metricName="mse") if task == "regression" else MulticlassClassificationEvaluator(metricName="accuracy")
    cv = CrossValidator(estimator=est, estimatorParamMaps=built.build(), evaluator=judge, numFolds=folds, foldCol="cv_fold", parallelism=4)
    return cv.fit(rows)


def grid_scores(model) -> list[tuple[str, float]]:
    out = []
    for params, score in zip(model.getEstimatorParamMaps(), model.avgMetrics):
        out.append((", ".join(f"{p.name}={v}" for p, v in sorted(params.items(), key=lambda t: t[0].name)), float(score)))
    return out
