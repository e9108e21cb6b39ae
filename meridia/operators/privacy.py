"""Differentially private releases and site-wise fitting without pooling rows."""

from __future__ import annotations

import math
import secrets
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.functions.columns import clip, gaussian, ratio, uniform
from meridia.operators import gram as G
from meridia.operators.noise import Ledger, Stream, new_key, noisy, released
from meridia.session import durable


# ---- noise scales (driver scalars)

def _check(eps: float, delta: float, sensitivity: float = 1.0) -> None:
    if not eps > 0:
        raise ValueError("epsilon must be positive")
    if not 0 < delta < 1:
        raise ValueError("delta must lie in (0, 1)")
    if sensitivity < 0:
        raise ValueError("sensitivity must not be negative")


def classic_sigma(sensitivity: float, eps: float, delta: float) -> float:
    """Textbook Gaussian mechanism, valid for eps <= 1."""
    _check(eps, delta, sensitivity)
    if math.isinf(eps) or sensitivity == 0:
        return 0.0
    return sensitivity * math.sqrt(2 * math.log(1.25 / delta)) / eps


def privacy_loss(sigma: float, sensitivity: float, eps: float) -> float:
    """delta reached by noise of scale sigma at this eps (exact Gaussian curve)."""
    cdf = NormalDist().cdf
    half, tilt = sensitivity / (2 * sigma), eps * sigma / sensitivity
    right = cdf(-half - tilt)
    return cdf(half - tilt) - (math.exp(eps + math.log(right)) if right > 0 else 0.0)


def analytic_sigma(sensitivity: float, eps: float, delta: float) -> float:
    """Smallest Gaussian scale whose exact curve meets (eps, delta); bisection."""
    _check(eps, delta, sensitivity)
    if math.isinf(eps) or sensitivity == 0:
        return 0.0
    lo, hi = 1e-12, 1.0
    while privacy_loss(hi, 1.0, eps) > delta:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if privacy_loss(mid, 1.0, eps) > delta:
            lo = mid
        else:
            hi = mid
    return hi * sensitivity


SIGMAS = {"analytic": analytic_sigma, "classic": classic_sigma}


def _unit_sigma(kind: str, eps: float, delta: float) -> float:
    if kind not in SIGMAS:
        raise ValueError(f"unknown calibration {kind!r}")
    return SIGMAS[kind](1.0, eps, delta)  # both scales are linear in the sensitivity


# ---- private means

def dp_mean(df: DataFrame, value: str, eps: float, delta: float, lo: float, hi: float, *,
            keys: list[str] | None = None, seed: int | None = None, calibration: str = "analytic",
            ledger: Ledger | None = None) -> DataFrame:
    """Clipped mean per key + discrete Gaussian noise of a fresh key, stored; eps = inf releases the clipped mean.

    Keys hold different rows, so all groups together spend eps once.
    """
    if hi <= lo:
        raise ValueError("the clipping range is empty")
    unit = _unit_sigma(calibration, eps, delta)
    keys = keys or []
    if not keys and df.where(F.col(value).isNotNull()).isEmpty():
        raise ValueError("nothing but NULL in the column to average")
    stats = df.groupBy(*keys).agg(F.avg(clip(F.col(value), lo, hi)).alias("m"), F.count(value).alias("n")).where("n > 0")
    sigma = ratio(F.lit((hi - lo) * unit), F.col("n"))
    if ledger:
        ledger.spend("dp_mean", eps, delta)
    return durable(stats.select(
        *keys, "n", released(F.col("m"), sigma, keys, new_key(seed)).alias("dp_mean"), sigma.alias("sigma")), "release")


def dp_summary(long: DataFrame, eps: float, delta: float, bounds: dict[str, tuple[float, float]] | None = None, *,
               seed: int | None = None, calibration: str = "analytic", ledger: Ledger | None = None) -> DataFrame:
    """Per feature (feature, value rows): true and private mean with the budget split evenly; stored, the noise as in dp_mean.

    Observed bounds depend on the data, so ``bounds_source`` says where they came from.
    """
    v, present = F.col("value"), long.where(F.col("value").isNotNull())
    if bounds is None:  # clipping to observed bounds changes nothing, so one aggregate has it all
        stats = present.groupBy("feature").agg(
            F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(F.lit(1)).alias("n"), F.avg(v).alias("true_mean")
        ).withColumn("m", F.col("true_mean"))
    else:
        given = long.sparkSession.createDataFrame(
            [(k, float(a), float(b)) for k, (a, b) in bounds.items()], "feature string, lo double, hi double")
        stats = present.join(given, "feature", "left").groupBy("feature", "lo", "hi").agg(
            F.count(F.lit(1)).alias("n"), F.avg(v).alias("true_mean"), F.avg(clip(v, F.col("lo"), F.col("hi"))).alias("m"))
    stats = durable(stats, "stats")  # one row per feature
    d, bounded = stats.agg(F.count(F.lit(1)), F.count("lo")).first()
    if d == 0:
        raise ValueError("the table names no feature")
    if bounded != d or (bounds is not None and len(bounds) != d):
        raise ValueError(f"each of the {d} features needs its clipping range, and no other")
    unit = _unit_sigma(calibration, eps if math.isinf(eps) else eps / d, delta / d)
    open_ = F.col("hi") > F.col("lo")
    sigma = F.when(open_, (F.col("hi") - F.col("lo")) / F.col("n") * unit).otherwise(0.0)
    if ledger:
        ledger.spend("dp_summary", eps, delta)
    drawn = stats.withColumn("sigma", sigma).withColumn("dp", released(F.when(open_, F.col("m")).otherwise(
        F.col("true_mean")), F.col("sigma"), ["feature"], new_key(seed)))
    return durable(drawn.select(
        "feature", "true_mean", F.col("dp").alias("dp_mean"), F.abs(F.col("dp") - F.col("true_mean")).alias("abs_error"),
        "sigma", "lo", "hi", F.lit("given" if bounds else "observed").alias("bounds_source")), "release")


def unit_rows(df: DataFrame, x: str) -> DataFrame:
    """Adds ``features``: rows scaled to length 1 (zero rows stay zero)."""
    raw = df.withColumn("raw", array_to_vector(F.transform(F.col(x), lambda v: v.cast("double"))))
    return Normalizer(inputCol="raw", outputCol="features", p=2.0).transform(raw).drop("raw")


def dp_logistic(df: DataFrame, x: str, y: str, eps: float, delta: float, lam: float = 0.01, seed: int | None = None,
                calibration: str = "analytic", ledger: Ledger | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """(noisy coefficients, exact coefficients, sigma) of a no-intercept logistic fit on unit rows."""
    strange, n = df.agg(F.count_if(~F.col(y).isin(0, 1)), F.count(F.lit(1))).first()
    if strange or not n:
        raise ValueError("labels must be 0 or 1")
    if lam <= 0:
        raise ValueError("lam must be positive")
    rows = unit_rows(df, x).select(F.col(y).cast("double").alias("label"), "features")
    fit = LogisticRegression(regParam=lam, fitIntercept=False, standardization=False, maxIter=200, tol=1e-10).fit(rows)
    w = fit.coefficients.toArray()
    sigma = SIGMAS[calibration](2.0 / (n * lam), eps, delta)
    if ledger:
        ledger.spend("dp_logistic", eps, delta)
    key = new_key(seed)
    return np.array([noisy(float(c), sigma, Stream(key, str(i))) for i, c in enumerate(w)]), w, sigma


def privacy_sweep(df: DataFrame, x: str, y: str, long: DataFrame, eps_grid: list[float], reps: int, delta: float = 1e-5,
                  lam: float = 0.01, key: str = "key", seed: int | None = None) -> DataFrame:
    """epsilon, metric, value: held-out accuracy of the noisy model, mean absolute and relative error of private means.

    One fit and one scoring pass serve every (epsilon, replicate); the errors of the
    means come from the per-feature aggregates alone.  The noise is simulated to judge a
    budget; nothing here is a release.
    """
    held = uniform(key, seed=0) < 0.3
    draw = secrets.randbits(62) if seed is None else seed
    train = df.where(~held)
    _, w, _ = dp_logistic(train, x, y, math.inf, delta, lam)
    n = train.count()
    models, tags = [], []
    for eps in eps_grid:
        for r in range(1 if math.isinf(eps) else reps):
            s = analytic_sigma(2.0 / (n * lam), eps, delta)
            models.append(w + np.random.default_rng([draw, r]).normal(0, 1, len(w)) * s)
            tags.append(eps)
    spark = df.sparkSession
    stacked = np.array(models)
    test = unit_rows(df.where(held), x).select(F.col(y).cast("int").alias("y"), vector_to_array("features").alias("z"))
    right = test.withColumn("c", F.lit(0)).select("c", F.concat(F.array(F.col("y").cast("double")), "z").alias("z"))
    sums = G.summed(right, ["c"], lambda z: np.concatenate([[len(z)], np.sum((z[:, 1:] @ stacked.T >= 0) == (z[:, :1] > 0), axis=0)]))
    total = np.sum([np.asarray(row["v"]) for row in sums.collect()], axis=0)
    acc = total[1:] / total[0]
    rows = [(e, "dp_logistic_accuracy", float(np.mean([a for a, t in zip(acc, tags) if t == e]))) for e in eps_grid]

    exact = dp_summary(long, math.inf, delta)
    d = exact.count()
    base = durable(exact.join(long.groupBy("feature").agg(F.count("value").alias("n")), "feature"), "base")
    scale = base.agg(F.avg(F.abs("true_mean"))).first()[0]
    sigma_1 = {e: 0.0 if math.isinf(e) else analytic_sigma(1.0, e / d, delta / d) for e in eps_grid}
    grid = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(sigma_1[e]).alias("unit"), F.lit(1 if math.isinf(e) else reps).alias("reps"))
                     for i, e in enumerate(eps_grid)])
    draws = base.select("*", F.inline(grid)).withColumn("rep", F.explode(F.sequence(F.lit(1), "reps")))
    s = (F.col("hi") - F.col("lo")) / F.col("n") * F.col("unit")
    errors = draws.groupBy("at").agg(F.avg(F.abs(s * gaussian("feature", "rep", "at", seed=draw))).alias("e")).collect()
    for row in sorted(errors, key=lambda r: r["at"]):
        eps = eps_grid[row["at"]]
        rows += [(eps, "dp_mean_abs_error", float(row["e"])), (eps, "dp_mean_rel_error", float(row["e"] / scale))]
    return spark.createDataFrame(rows, "epsilon double, metric string, value double")


# ---- site-wise fitting

def weighted_param_average(sites: DataFrame, params: str = "params", size: str = "n") -> DataFrame:
    """pos, value: size-weighted mean of equally long parameter arrays, one row per site in."""
    n, low, total, short, long = sites.agg(
        F.count(F.lit(1)), F.min(size), F.sum(size), F.min(F.size(params)), F.max(F.size(params))).first()
    if not n:
        raise ValueError("there is no site to average over")
    if short != long:
        raise ValueError("parameter arrays differ in length between sites")
    if low < 0 or total <= 0:
        raise ValueError("sizes cannot serve as weights: one is negative or all are zero")
    w = F.col(size).cast("double")
    return sites.select(w.alias("w"), F.posexplode(params).alias("pos", "p")).groupBy("pos").agg(
        ratio(F.sum(F.col("w") * F.col("p")), F.sum("w")).alias("value"))


def _sigmoid(t: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(t, -500, 500)))


def _newton_sums(z: np.ndarray, coef: np.ndarray) -> np.ndarray:
    """Gradient and Hessian of the logistic loss over rows z = [1, x..., y]."""
    a, y = z[:, :-1], z[:, -1]
    p = _sigmoid(a @ coef)
    return np.concatenate([a.T @ (p - y), ((a * (p * (1 - p))[:, None]).T @ a).ravel()])


def _newton_step(coef: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The step from gradient and Hessian sums; the intercept is not penalized."""
    p = len(coef)
    penalty = np.eye(p)
    penalty[0, 0] = 0.0
    return np.linalg.lstsq(sums[p:].reshape(p, p) + penalty, sums[:p] + penalty @ coef, rcond=None)[0]


def site_logistic(z: np.ndarray, max_iter: int = 30, tol: float = 1e-8) -> np.ndarray:
    """Penalized logistic coefficients of the rows z = [1, x..., y] of one site."""
    coef = np.zeros(z.shape[1] - 1)
    for _ in range(max_iter):
        move = _newton_step(coef, _newton_sums(z, coef))
        coef = coef - move
        if np.max(np.abs(move)) < tol:
            break
    return coef


def ridge_of_sums(m: np.ndarray) -> np.ndarray:
    """Ridge (penalty 1, free intercept) from the cross products of rows z = [1, x..., y]."""
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    cov = m[1:, 1:] - n * np.outer(mean, mean)
    b = np.linalg.solve(cov[:-1, :-1] + np.eye(len(mean) - 1), cov[:-1, -1])
    return np.concatenate([[mean[-1] - mean[:-1] @ b], b])


def fit_sites(rows: DataFrame, site: str, p: int, *, max_iter: int = 30, tol: float = 1e-8) -> tuple[dict, np.ndarray]:
    """Penalized logistic coefficients per site, and of all rows together, for sites too large for a task.

    Newton steps: one pass sums gradient and Hessian per site over all tasks, so a
    large site is never gathered in one place.  ``rows`` holds site + z = [1, x, y].
    """
    coefs: dict = {}
    pooled = np.zeros(p + 1)
    half = (p + 1) * (p + 2)
    for _ in range(max_iter):
        local, joint = dict(coefs), pooled.copy()

        def sums(z: np.ndarray, key: tuple) -> np.ndarray:
            own = None if pd.isna(key[0]) else key[0]  # the NULL site
            return np.concatenate([_newton_sums(z, local.get(own, np.zeros(p + 1))), _newton_sums(z, joint)])

        got: dict = {}
        for row in G.summed(rows, [site], sums, keyed=True).collect():  # large sites x p^2 sums
            got[row[0]] = got.get(row[0], 0.0) + np.asarray(row["v"])
        moved = 0.0
        for s, v in got.items():
            now = coefs.get(s, np.zeros(p + 1))
            move = _newton_step(now, v[:half])
            coefs[s] = now - move
            moved = max(moved, float(np.max(np.abs(move))))
        move = _newton_step(pooled, sum(v[half:] for v in got.values()))
        pooled = pooled - move
        if max(moved, float(np.max(np.abs(move)))) < tol:
            break
    return coefs, pooled


#: Rows of a site that one task fits on its own.
SITE_ROWS = 100_000


def site_models(rows: DataFrame, p: int, task: str, most: int = SITE_ROWS) -> DataFrame:
    """site, n, coef: the local model of every site of ``rows`` (site, z = [1, x, y]); coef is NULL with one class only.

    A site of at most ``most`` rows is fitted inside one task.  A larger one is summed
    over all tasks; there are at most rows / ``most`` of these.
    """
    kind = dict(rows.dtypes)["site"]
    out = f"site {kind}, n bigint, coef array<double>"
    label = F.element_at("z", -1)
    sizes = durable(rows.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.min(label).alias("y0"), F.max(label).alias("y1")), "sizes")
    one_class = (F.col("y0") == F.col("y1")) if task == "classification" else F.lit(False)
    fitted = sizes.where(~one_class)

    def local(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.stack(pdf["z"].to_numpy()).astype(float)
        coef = site_logistic(z) if task == "classification" else ridge_of_sums(z.T @ z)
        return pd.DataFrame({"site": [key[0]], "n": [len(z)], "coef": [coef]})

    mine = rows.alias("r").join(fitted.where(F.col("n") <= most).select("site").alias("s"), F.expr("r.site <=> s.site"), "left_semi")
    small = mine.groupBy("site").applyInPandas(local, out)
    none = sizes.where(one_class).select("site", "n", F.lit(None).cast("array<double>").alias("coef"))
    big = fitted.where(F.col("n") > most).select("site", "n")
    if big.isEmpty():
        return small.unionByName(none)
    large = durable(rows.alias("r").join(big.alias("s"), F.expr("r.site <=> s.site"), "left_semi"), "large")
    if task == "classification":
        coefs, _ = fit_sites(large, "site", p)
    else:
        sums: dict = {}
        for row in G.summed(large, ["site"], lambda z: (z.T @ z).ravel()).toLocalIterator():
            sums[row[0]] = sums.get(row[0], 0.0) + np.asarray(row["v"]).reshape(p + 2, p + 2)
        coefs = {s: ridge_of_sums(m) for s, m in sums.items()}
    table = rows.sparkSession.createDataFrame([(s, [float(v) for v in c]) for s, c in coefs.items()], f"l_site {kind}, coef array<double>")
    found = big.join(table, big["site"].eqNullSafe(table["l_site"])).select("site", "n", "coef")
    return small.unionByName(none).unionByName(found)


def site_partitioned_fit(df: DataFrame, key: str, site: str, x: str, y: str, rounds: int = 5, test_share: float = 0.3,
                         task: str = "classification", seed: int = 0, most: int = SITE_ROWS) -> DataFrame:
    """round, score, central_score, gap: size-weighted averaging of site models against one central fit.

    Same split and train-only scaling for both.  A site with one class sends the
    global parameters back.  The local optimum does not depend on the starting
    point, so it is found once and every round only averages.  Of the sites the driver
    sees one weighted sum of parameters.
    """
    held = (uniform(key, seed=seed) < test_share).cast("int")
    rows = durable(df.select(F.col(site).alias("site"), held.alias("held"), F.transform(F.col(x), lambda v: v.cast("double")).alias("x"),
                             F.col(y).cast("double").alias("y")), "sites")
    g = G.grams(G.design(rows, F.col("x"), [F.col("y")], ["held"]), ["held"], 1)
    mo = G.moments(g.cells[0], g.p, g.centre)
    mean, sd, p = mo.mean[: mo.p], mo.sd, mo.p
    centre, scale = (F.array(*[F.lit(float(v)) for v in a]) for a in (mean, sd))
    scaled = F.zip_with(F.zip_with("x", centre, lambda a, b: a - b), scale, lambda a, b: a / b)
    fit_rows = durable(rows.where("held = 0").select("site", F.concat(F.array(F.lit(1.0)), scaled, F.array("y")).alias("z")), "fit")
    models = durable(site_models(fit_rows, p, task, most), "models")
    total = models.agg(F.sum("n"), F.coalesce(F.sum(F.when(F.col("coef").isNull(), F.col("n"))), F.lit(0))).first()
    weighted = np.zeros(p + 1)
    sums = models.where("coef IS NOT NULL").select("n", F.posexplode("coef").alias("i", "c")).groupBy("i").agg(F.sum(F.col("n") * F.col("c")).alias("s"))
    for row in sums.collect():  # p + 1 numbers
        weighted[row["i"]] = row["s"]
    shared, averages = np.zeros(p + 1), []
    for _ in range(rounds):
        shared = (weighted + total[1] * shared) / total[0]
        averages.append(shared)
    whole = fit_rows.select(F.lit(0).alias("site"), "z")
    if task == "classification":
        _, central = fit_sites(whole, "site", p)
    else:
        central = ridge_of_sums(sum(np.asarray(r["v"]) for r in G.summed(whole, ["site"], lambda z: (z.T @ z).ravel()).collect()).reshape(p + 2, p + 2))
    test = rows.where("held = 1").select(F.lit(0).alias("c"), F.concat(F.array(F.lit(1.0)), scaled, F.array("y")).alias("z"))
    stacked = np.array([*averages, central]).T

    def judge(z: np.ndarray) -> np.ndarray:
        s, t = z[:, :-1] @ stacked, z[:, -1:]
        hit = np.sum((s >= 0) == (t > 0.5), axis=0) if task == "classification" else np.sum((s - t) ** 2, axis=0)
        return np.concatenate([[len(z), t.sum(), (t * t).sum()], hit])

    v = np.sum([np.asarray(row["v"]) for row in G.summed(test, ["c"], judge).collect()], axis=0)
    n, sy, syy = v[:3]
    scores = v[3:] / n if task == "classification" else 1 - v[3:] / (syy - sy * sy / n)
    out = [(i + 1, float(s), float(scores[-1]), float(scores[-1] - s)) for i, s in enumerate(scores[:-1])]
    return df.sparkSession.createDataFrame(out, "round int, score double, central_score double, gap double")
