"""Bootstrap intervals, label permutations and trivial baselines."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.functions.columns import gaussian, ratio
from meridia.operators import gram as G
from meridia.operators.metrics import classification_metrics
from meridia.operators.models import RIDGE_ALPHAS, fold_grams, hash_fold, nested_ridge, train_moments
from meridia.operators.ordered import PART, lay_out, ordered
from meridia.session import durable

HIGHER_WINS = {"R2": True, "Pearson": True, "Spearman": True, "AUROC": True, "F1": True,
                     "Accuracy": True, "RMSE": False, "MAE": False}


def poisson_weights(keys: np.ndarray, counts: np.ndarray, reps: int, seed: int) -> np.ndarray:
    """Bootstrap multiplicities (rows x reps): Poisson(count) drawn from a hash of the row key.

    A group of ``count`` identical rows gets the sum of that many Poisson(1) draws,
    which is one Poisson(count) draw, so rows may be counted before resampling.
    """
    with np.errstate(over="ignore"):
        mix = keys.astype(np.int64).view(np.uint64)[:, None] + np.uint64(0x9E3779B97F4A7C15) * (
            np.arange(1, reps + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003))[None, :]
        mix = (mix ^ (mix >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mix = (mix ^ (mix >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        mix = mix ^ (mix >> np.uint64(31))
    u = (mix >> np.uint64(11)).astype(float) / float(2**53)
    out = np.empty(u.shape)
    for c in np.unique(counts):  # the distribution function, twelve deviations around its mean
        reach = 12 * np.sqrt(c) + 20
        low = max(0, int(c - reach))
        k = np.arange(low, int(c + reach))
        steps = np.log(np.maximum(k, 1))
        steps[0] = math.lgamma(low + 1)
        rows = counts == c
        out[rows] = low + np.searchsorted(np.cumsum(np.exp(k * np.log(c) - c - np.cumsum(steps))), u[rows])
    return out


def _slices(batches: Iterator[pd.DataFrame], rows: int = 2048) -> Iterator[pd.DataFrame]:
    """Bound the (rows x replicates) work arrays whatever the batch size is."""
    for pdf in batches:
        for at in range(0, len(pdf), rows):
            yield pdf.iloc[at: at + rows]


REG_SUMS = ["w", "y", "p", "yy", "pp", "yp", "ae"]


def _regression_sums(df: DataFrame, y: str, p: str, reps: int, seed: int) -> DataFrame:
    """rep + weighted sums, one row per replicate; rep -1 is the sample itself."""
    counted = df.groupBy(F.col(y).cast("double").alias("y"), F.col(p).cast("double").alias("p")).agg(
        F.count(F.lit(1)).alias("c")).withColumn("h", F.xxhash64("y", "p"))

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in _slices(batches):
            ys, ps, c = pdf["y"].to_numpy(float), pdf["p"].to_numpy(float), pdf["c"].to_numpy(float)
            w = np.column_stack([c, poisson_weights(pdf["h"].to_numpy(), c, reps, seed)])
            cols = np.column_stack([np.ones_like(ys), ys, ps, ys * ys, ps * ps, ys * ps, np.abs(ys - ps)])
            got = w.T @ cols
            total = got if total is None else total + got
        if total is not None:
            out = pd.DataFrame(total, columns=REG_SUMS)
            out.insert(0, "rep", np.arange(-1, reps))
            yield out

    parts = counted.mapInPandas(local, "rep int, " + ", ".join(f"{c} double" for c in REG_SUMS))
    return parts.groupBy("rep").agg(*[F.sum(c).alias(c) for c in REG_SUMS])


def bootstrap_regression(df: DataFrame, y: str, p: str, reps: int = 2000, seed: int = 0) -> DataFrame:
    """rep, R2, RMSE, MAE, Pearson (NULL where undefined)."""
    s = _regression_sums(df, y, p, reps, seed)
    n, c = F.col("w"), F.col
    sst, spp = c("yy") - c("y") * c("y") / n, c("pp") - c("p") * c("p") / n
    sse = c("yy") - 2 * c("yp") + c("pp")
    return s.where(n > 0).select(
        "rep", F.when(sst > 1e-12, 1 - sse / sst).alias("R2"), F.sqrt(F.greatest(sse, F.lit(0.0)) / n).alias("RMSE"),
        (c("ae") / n).alias("MAE"),
        F.when((sst > 1e-12) & (spp > 1e-12), (c("yp") - c("y") * c("p") / n) / F.sqrt(sst * spp)).alias("Pearson"),
    )


def bootstrap_classification(df: DataFrame, y: str, p: str, reps: int = 2000, seed: int = 0) -> DataFrame:
    """rep, Accuracy, F1 (macro), AUROC for 0/1 labels.

    Scores are counted, laid out in score order, and each partition reports its own
    concordances and weights per replicate; a running sum over partitions adds the rest.
    """
    counted = df.groupBy(F.col(p).cast("double").alias("p")).agg(
        F.count_if(F.col(y) == 1).alias("c1"), F.count_if(F.col(y) != 1).alias("c0"))
    laid = lay_out(counted.withColumn("all", F.lit(0)), ["all"], ["p"])
    names = ["w1", "w0", "u", "tp", "fp"]

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for pdf in _slices(batches):  # rows of one partition arrive sorted by score
            for part, rows in pdf.groupby(PART, sort=False):
                key = rows["h"].to_numpy()
                w1 = np.zeros((len(rows), reps + 1))
                w0 = np.zeros_like(w1)
                for w, c, shift in ((w1, rows["c1"].to_numpy(float), 1), (w0, rows["c0"].to_numpy(float), 2)):
                    some = c > 0
                    w[:, 0] = c
                    if some.any():
                        w[some, 1:] = poisson_weights(key[some] * 2 + shift, c[some], reps, seed)
                state = sums.setdefault(part, np.zeros((5, reps + 1)))
                below = state[1] + np.cumsum(w0, axis=0) - w0
                yes = (rows["p"].to_numpy(float) >= 0.5)[:, None]
                state[2] += np.sum(w1 * (below + w0 / 2), axis=0)
                state[0] += w1.sum(axis=0)
                state[1] += w0.sum(axis=0)
                state[3] += (w1 * yes).sum(axis=0)
                state[4] += (w0 * yes).sum(axis=0)
        for part, state in sums.items():
            out = pd.DataFrame(state.T, columns=names)
            out.insert(0, "rep", np.arange(-1, reps))
            out.insert(0, PART, part)
            yield out

    sorted_ = laid.withColumn("h", F.xxhash64("p")).repartition(PART).sortWithinPartitions(PART, "p")
    parts = sorted_.mapInPandas(local, f"{PART} int, rep int, " + ", ".join(f"{c} double" for c in names))
    # one row per (partition, replicate): the group below is bounded by the partition count
    before = ordered(parts, ["rep"], [PART], sums={"seen0": F.col("w0")})
    s = before.withColumn("u", F.col("u") + F.col("w1") * (F.col("seen0") - F.col("w0"))).groupBy("rep").agg(
        *[F.sum(c).alias(c) for c in names])
    c = F.col
    fn, tn = c("w1") - c("tp"), c("w0") - c("fp")
    f_pos = ratio(2 * c("tp"), 2 * c("tp") + c("fp") + fn)
    f_neg = ratio(2 * tn, 2 * tn + c("fp") + fn)
    return s.where(c("w1") + c("w0") > 0).select(
        "rep", ((c("tp") + tn) / (c("w1") + c("w0"))).alias("Accuracy"),
        # a class absent from labels and predictions does not count
        F.when(f_pos.isNull(), f_neg).when(f_neg.isNull(), f_pos).otherwise((f_pos + f_neg) / 2.0).alias("F1"),
        ratio(c("u"), c("w1") * c("w0")).alias("AUROC"),
    )


def intervals(boot: DataFrame, alpha: float = 0.05) -> DataFrame:
    """metric, point, lo, hi: percentile interval over the defined replicates (bounded by their number)."""
    names = [c for c in boot.columns if c != "rep"]
    long = boot.unpivot(["rep"], names, "metric", "v")
    sample = F.col("rep") >= 0
    return long.groupBy("metric").agg(
        F.max(F.when(~sample, F.col("v"))).alias("point"),
        F.percentile(F.when(sample, F.col("v")), F.lit(alpha / 2)).alias("lo"),
        F.percentile(F.when(sample, F.col("v")), F.lit(1 - alpha / 2)).alias("hi"),
    )


def permuted_labels(df: DataFrame, key: str, y: str, perms: int, seed: int = 0) -> DataFrame:
    """key + ``y_perm``: array of ``perms`` exact permutations of the label column.

    Every permutation orders the labels by a hash of (row, permutation) and hands
    them to the rows in key order; all are placed by one distributed sort.
    """
    base = ordered(df.select(key, F.col(y).cast("double").alias("y")), [], [key], pos="row")
    copies = base.select(key, "y", F.explode(F.sequence(F.lit(0), F.lit(perms - 1))).alias("b"))
    mixed = copies.withColumn("h", F.xxhash64(key, "b", F.lit(seed)))
    placed = ordered(mixed, ["b"], ["h", key], pos="row").groupBy("row").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("b", "y"))), lambda s: s["y"]).alias("y_perm"))
    return base.join(placed, "row").select(key, "y_perm")


def permutation_scores(df: DataFrame, key: str, x: str, y: str, fold: str, perms: int, seed: int = 0, alpha: float = 0.0) -> dict:
    """Scores of the cross-validated linear model on the true labels (entry 0) and each permutation.

    The permuted labels are extra label columns of the same matrices, so x'x is formed once.
    """
    shuffled = durable(df.join(permuted_labels(df, key, y, perms, seed), key), "permuted")
    ys = [F.col(y).cast("double")] + [F.col("y_perm")[i] for i in range(perms)]
    g = G.grams(G.design(shuffled, F.col(x), ys, [fold]), [fold], perms + 1)
    pooled = np.zeros((6, perms + 1))
    for f, held in g.cells.items():
        pooled += G.held_out(held, g.centre, g.p, G.ridge(train_moments(g, f), alpha), np.arange(perms + 1))
    return G.pooled_scores(pooled)


def _tuned_ridge(rows: DataFrame, g: G.Grams, fold: str, alphas: np.ndarray) -> dict:
    """Per fold: ridge coefficients (p+1 x labels), the penalty of every label by leave-one-out error on the training rows.

    ``rows`` holds ``fold``, ``x`` and the labels ``ys``; all folds, penalties and labels are scored in one pass.
    """
    plans = {}
    for f in g.cells:
        mo = train_moments(g, f)
        a, b = mo.standardized()
        lam, vec = np.linalg.eigh(a)
        plans[f] = mo, np.clip(lam, 0, None), vec, vec.T @ b

    def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for pdf in _slices(batches):
            raw, ys = np.stack(pdf["x"].to_numpy()).astype(float), np.stack(pdf["ys"].to_numpy()).astype(float)
            own = pdf["fold"].to_numpy()
            for f, (mo, lam, vec, vb) in plans.items():
                used = own != f
                t = ((raw[used] - mo.mean[: mo.p]) / mo.sd) @ vec
                away = ys[used] - mo.mean[mo.p:]
                part = np.empty((len(alphas), ys.shape[1]))
                for i, alpha in enumerate(alphas):
                    d = 1.0 / (lam + alpha / mo.n)
                    h = 1.0 / mo.n + (t * t) @ d / mo.n
                    part[i] = np.sum(((away - t @ (d[:, None] * vb)) / (1.0 - np.clip(h, 0, 1 - 1e-12))[:, None]) ** 2, axis=0)
                sums[f] = sums.get(f, 0.0) + part
        if sums:
            yield pd.DataFrame({"f": list(sums), "sse": [v.ravel().tolist() for v in sums.values()]})

    kind = dict(rows.dtypes)[fold]
    parts = rows.select("x", "ys", F.col(fold).alias("fold")).mapInPandas(errors, f"f {kind}, sse array<double>")
    got = {f: np.zeros((len(alphas), len(g.centre) - 1 - g.p)) for f in plans}
    merged = parts.select("f", F.posexplode("sse").alias("i", "e")).groupBy("f", "i").agg(F.sum("e").alias("e"))
    for row in merged.collect():  # folds x penalties x labels
        got[row["f"]].flat[row["i"]] = row["e"]
    coefs = {}
    for f, (mo, *_) in plans.items():
        best = np.argmin(got[f], axis=0)
        coefs[f] = np.empty((g.p + 1, len(best)))
        for i in np.unique(best):
            coefs[f][:, best == i] = G.ridge(mo, float(alphas[i]))[:, best == i]
    return coefs


def permuted_classifier(df: DataFrame, key: str, x: str, y: str, fold: str, perms: int, seed: int = 0,
                        alphas: np.ndarray = RIDGE_ALPHAS) -> DataFrame:
    """perm, y_true, y_pred: out-of-fold scores of the tuned ridge classifier on 0/1 labels (perm 0) and each permutation.

    The permuted labels are extra label columns of the same matrices; every permutation tunes its own penalty in every fold.
    """
    mixed = permuted_labels(df, key, y, perms, seed)
    shuffled = durable(df.join(mixed, key).select(
        fold, F.col(x).alias("x"), F.concat(F.array(F.col(y).cast("double")), "y_perm").alias("ys")), "permuted")
    g = G.grams(G.design(shuffled, F.col("x"), [F.col("ys")[i] for i in range(perms + 1)], [fold]), [fold], perms + 1)
    coefs = _tuned_ridge(shuffled, g, fold, alphas)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _slices(batches):
            for f, part in pdf.groupby("fold", sort=False):
                preds = coefs[f][0] + np.stack(part["x"].to_numpy()).astype(float) @ coefs[f][1:]
                yield pd.DataFrame({"ys": part["ys"].to_numpy(), "ps": list(preds)})

    scored = shuffled.select(F.col(fold).alias("fold"), "x", "ys").mapInPandas(score, "ys array<double>, ps array<double>")
    return scored.select(F.posexplode(F.arrays_zip("ys", "ps")).alias("perm", "s")).select(
        "perm", F.col("s.ys").cast("int").alias("y_true"), F.col("s.ps").alias("y_pred"))


def classifier_scores(scored: DataFrame, perms: int) -> dict:
    """AUROC and F1 of :func:`permuted_classifier` rows: the true labels' (entry 0) and each permutation's."""
    got = {m: np.full(perms + 1, np.nan) for m in ("AUROC", "F1")}
    for row in classification_metrics(scored, "y_true", "y_pred", ["perm"]).collect():  # one per permutation
        for m, v in got.items():
            v[row["perm"]] = np.nan if row[m] is None else row[m]
    return got


def permutation_p(scores: np.ndarray, greater: bool = True, observed: float | None = None) -> float:
    """(1 + permutations at least as good) / (1 + permutations); undefined ones only count below the line."""
    obs = scores[0] if observed is None else observed
    null = scores[1:]
    ok = null[np.isfinite(null)]
    hits = np.sum(ok >= obs) if greater else np.sum(ok <= obs)
    return float((1 + hits) / (1 + len(null)))


def mean_baseline(df: DataFrame, y: str) -> DataFrame:
    """R2 of predicting each row by the mean of all others: one aggregate; NULL for fewer than two rows."""
    n, s = F.count(y), F.sum(y)
    sse = F.pow(ratio(n, n - 1), F.lit(2.0)) * F.var_pop(y) * n
    return df.agg((1.0 - ratio(sse, F.var_pop(y) * n)).alias("R2"), ratio(s, n).alias("mean"), n.alias("n"))


def baseline_scores(df: DataFrame, key: str, x: str, y: str, outer: int = 5, inner: int = 5, seed: int = 0) -> dict:
    """Nested, non-nested, shuffled-rows and random-feature scores of the tuned ridge model."""
    rows = df.select(
        key, F.col(x).alias("x"), F.col(y).cast("double").alias("y"),
        hash_fold(key, outer, seed).alias("fold"), hash_fold(key, inner, seed + 1).alias("inner"))
    shuffled = rows.join(permuted_labels(rows, key, "y", 1, seed), key).withColumn("y_mixed", F.col("y_perm")[0])
    shuffled = durable(shuffled, "permuted")
    both = fold_grams(shuffled, "x", ["y", "y_mixed"], "fold", ("inner",))
    noise = rows.withColumn("x", F.transform(F.sequence(F.lit(1), F.size("x")), lambda j: gaussian(F.col(key), j, seed=seed + 7)))
    random = fold_grams(noise, "x", ["y"], "fold", ("inner",))
    honest, _ = nested_ridge(both)
    leaky, _ = nested_ridge(both, nested=False)
    return {
        "nested": honest, "nonnested": leaky, "shuffled": nested_ridge(both, label=1)[0], "random": nested_ridge(random)[0],
    }


