"""Consensus feature selection inside cross-validation folds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.functions.special import critical_correlation
from meridia.operators import gram as G
from meridia.operators.models import (
    EN_L1, RIDGE_ALPHAS, elastic_net_fold, fold_grams, ridge_loo_errors, score_folds, train_moments,
)
from meridia.session import durable


@dataclass
class ConsensusRules:
    """Fixed values of the voting scheme."""

    votes_needed: int = 3
    alpha: float = 0.05
    min_gain: float = 0.01
    max_features: int = 6
    top: int = 5
    zero: float = 1e-6


def filter_votes(mo: G.Moments, rules: ConsensusRules) -> set[int]:
    a = mo.cov
    with np.errstate(divide="ignore", invalid="ignore"):
        r = a[: mo.p, mo.p] / np.sqrt(np.diag(a)[: mo.p] * a[mo.p, mo.p])
    limit = critical_correlation(mo.n, rules.alpha)
    return set(np.flatnonzero(np.abs(np.nan_to_num(r)) > limit).tolist())


def explain_votes(mo: G.Moments, rules: ConsensusRules) -> set[int]:
    a, b = mo.standardized()
    beta = np.linalg.pinv(a, hermitian=True) @ b[:, 0]
    return set(np.argsort(-np.abs(beta), kind="stable")[: rules.top].tolist())


def embedded_votes(g: G.Grams, fold, rules: ConsensusRules) -> set[int]:
    picks: set[int] = set()
    for l1 in (np.array([1.0]), EN_L1):
        coef, _, _ = elastic_net_fold(g, fold, l1=l1)
        scaled = coef[1:] * train_moments(g, fold).sd
        picks |= set(np.flatnonzero(np.abs(scaled) > rules.zero).tolist())
    return picks


def _candidate_errors(df: DataFrame, fold: str, g: G.Grams, sets: dict) -> dict:
    """Summed squared leave-one-out errors on train rows for many feature sets per fold, in one pass."""
    plans = {}
    for f, candidates in sets.items():
        total = g.without(lambda c: (c[0] if isinstance(c, tuple) else c) == f)
        plans[f] = []
        for idx in candidates:
            at = np.array([0, *[i + 1 for i in idx]])
            inv = np.linalg.pinv(total[np.ix_(at, at)], hermitian=True)
            plans[f].append((at, inv, inv @ total[at, g.p + 1]))
    centre, p = g.centre, g.p

    def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {f: np.zeros(len(v)) for f, v in plans.items()}
        for pdf in batches:
            z = np.column_stack([np.ones(len(pdf)), np.stack(pdf["x"].to_numpy()).astype(float) - centre[1: p + 1]])
            y, own = pdf["y"].to_numpy(float) - centre[p + 1], pdf["fold"].to_numpy()
            for f, plan in plans.items():
                rows = own != f
                zf, yf = z[rows], y[rows]
                for i, (at, inv, beta) in enumerate(plan):
                    t = zf[:, at]
                    h = np.clip(np.sum((t @ inv) * t, axis=1), 0, 1 - 1e-12)
                    sums[f][i] += np.sum(((yf - t @ beta) / (1 - h)) ** 2)
        yield pd.DataFrame([(f, i, float(v)) for f, vec in sums.items() for i, v in enumerate(vec)], columns=["f", "i", "e"])

    kind = dict(df.dtypes)[fold]
    rows = df.select("x", F.col("y").cast("double").alias("y"), F.col(fold).alias("fold"))
    merged = rows.mapInPandas(errors, f"f {kind}, i int, e double").groupBy("f", "i").agg(F.sum("e").alias("e"))
    out = {f: np.full(len(v), np.inf) for f, v in sets.items()}
    for row in merged.collect():  # folds x candidates
        out[row["f"]][row["i"]] = row["e"]
    return out


def wrapper_votes(df: DataFrame, fold: str, g: G.Grams, names: list[str], rules: ConsensusRules) -> dict:
    """Forward selection by closed-form leave-one-out R2, all folds advancing together."""
    folds = sorted({c[0] if isinstance(c, tuple) else c for c in g.cells})
    chosen: dict = {f: [] for f in folds}
    best = {f: -np.inf for f in folds}
    active = set(folds)
    while active:
        pool = {f: [i for i in range(g.p) if i not in chosen[f]] for f in active}
        pool = {f: c for f, c in pool.items() if c}
        if not pool:
            break
        errs = _candidate_errors(df, fold, g, {f: [[*chosen[f], c] for c in cs] for f, cs in pool.items()})
        for f, cs in pool.items():
            mo = train_moments(g, f)
            scores = 1 - errs[f] / (mo.cov[mo.p, mo.p] * mo.n)
            score, _, pick = max((s, names[c], c) for s, c in zip(scores, cs))
            if score - best[f] < rules.min_gain:
                active.discard(f)
                continue
            chosen[f].append(pick)
            best[f] = score
            if len(chosen[f]) >= rules.max_features:
                active.discard(f)
        active &= set(pool)
    return {f: set(v) for f, v in chosen.items()}


def all_votes(df: DataFrame, names: list[str], fold: str = "fold", inner: str = "inner", rules: ConsensusRules | None = None):
    """(matrices, votes): votes[fold][family] = set of feature indexes."""
    rules = rules or ConsensusRules()
    g = fold_grams(df, "x", ["y"], fold, (inner,))
    wrapped = wrapper_votes(df, fold, g, names, rules)
    votes = {}
    for f in wrapped:
        mo = train_moments(g, f)
        votes[f] = {"filter": filter_votes(mo, rules), "wrapper": wrapped[f],
                    "embedded": embedded_votes(g, f, rules), "explain": explain_votes(mo, rules)}
    return g, votes


def vote_frame(df: DataFrame, votes: dict, names: list[str]) -> DataFrame:
    """Long table: fold, family, feature."""
    rows = [(int(f), family, names[i]) for f, fams in votes.items() for family, picks in fams.items() for i in sorted(picks)]
    return df.sparkSession.createDataFrame(rows, "fold int, family string, feature string")


def frozen_sets(votes: dict, p: int, rules: ConsensusRules) -> dict:
    out = {}
    for f, fams in votes.items():
        count = np.zeros(p, dtype=int)
        for picks in fams.values():
            count[sorted(picks)] += 1
        kept = np.flatnonzero(count >= rules.votes_needed)
        out[f] = kept if len(kept) else np.array([int(np.argmax(count))])
    return out


def consensus_panel(df: DataFrame, key: str, names: list[str], fold: str = "fold", inner: str = "inner",
                    rules: ConsensusRules | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summary per final model, selection frequency, out-of-fold predictions).

    ``df`` holds key, x (array in the order of ``names``), y, and the two fold columns.
    """
    rules = rules or ConsensusRules()
    df = durable(df, "panel")
    g, votes = all_votes(df, names, fold, inner, rules)
    frozen = frozen_sets(votes, g.p, rules)
    errs = ridge_loo_errors(df, "x", "y", fold, _by_fold(g), frozen)
    kinds = {
        "Ridge": {f: G.ridge(train_moments(g, f), float(RIDGE_ALPHAS[int(np.argmin(errs[f]))]), i)[:, 0] for f, i in frozen.items()},
        "OLS": {f: G.ridge(train_moments(g, f), 0.0, i)[:, 0] for f, i in frozen.items()},
        "ElasticNet": {f: elastic_net_fold(g, f, i)[0] for f, i in frozen.items()},
    }
    keep = [key, fold, F.col("y").cast("double").alias("y_true")]
    preds = reduce(DataFrame.unionByName, [
        score_folds(df, "x", fold, coefs, [F.lit(kind).alias("final_model"), *keep]) for kind, coefs in kinds.items()])
    res = F.col("y_true") - F.col("y_pred")
    size = float(np.mean([len(i) for i in frozen.values()]))
    summary = preds.groupBy("final_model").agg(
        F.round(1 - F.try_divide(F.avg(res * res), F.var_pop("y_true")), 4).alias("external_R2"),
        F.round(F.avg(F.abs(res)), 4).alias("MAE"), F.round(F.sqrt(F.avg(res * res)), 4).alias("RMSE"),
        F.lit(round(size, 2)).alias("mean_frozen_set_size"), F.count(F.lit(1)).alias("n"))
    counts = np.zeros(g.p, dtype=int)
    for idx in frozen.values():
        counts[idx] += 1
    freq = df.sparkSession.createDataFrame(
        [(names[i], int(c), round(float(c) / len(frozen), 3), len(frozen)) for i, c in enumerate(counts)],
        "feature string, in_frozen_set int, frequency double, n_folds int")
    return summary, freq, preds


def _by_fold(g: G.Grams) -> G.Grams:
    """Merge (outer, inner) cells into outer folds."""
    out: dict = {}
    for c, m in g.cells.items():
        out[c[0]] = out[c[0]] + m if c[0] in out else m
    return G.Grams(out, g.centre, g.p)


def stable_panel(freq: DataFrame, top: int = 10) -> DataFrame:
    """Features frozen in every fold, or the ``top`` most frequent when there are none."""
    every = freq.where(F.col("in_frozen_set") == F.col("n_folds"))
    if every.isEmpty():
        return freq.orderBy(F.desc("in_frozen_set"), "feature").limit(top)
    return every
