import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meridia.functions import special
from meridia.operators import calibration as B
from meridia.operators import explain as X
from meridia.operators import fusion as U
from meridia.operators import gram as G
from meridia.operators import highdim as H
from meridia.operators import icc as I
from meridia.operators import models as M
from meridia.operators import privacy as V
from meridia.operators import resampling as S
from meridia.operators import scoring as C
from meridia.operators import selection as L
from meridia.operators import series as Z
from meridia.operators import transforms as T
from meridia.operators.models import RIDGE_ALPHAS
from meridia.session import durable, scratch_path

NAMES = [f"f{i}" for i in range(5)]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(3, 2, (60, 5)) * np.array([1, 10, 0.1, 1, 1])
    y = 3 * x[:, 0] - 0.2 * x[:, 1] + 0.1 * rng.normal(size=60)
    fold, inner = np.arange(60) % 4, (np.arange(60) // 4) % 5
    df = spark.createDataFrame(pd.DataFrame({"key": np.arange(60), "x": list(x), "y": y, "fold": fold, "inner": inner}).astype(
        {"fold": "int32", "inner": "int32"})).repartition(6)
    return x, y, fold, inner, durable(df)


def ridge_fit(x, y, alpha):
    m, s = x.mean(0), x.std(0)
    z = (x - m) / s
    b = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return lambda t: y.mean() + (t - m) / s @ b


@pytest.mark.parametrize("alpha", [0.0, 5.0])
def test_linear_cv_equals_refits(data, alpha):
    x, y, fold, _, df = data
    got = M.linear_cv(df, "key", "x", "y", alpha=alpha).toPandas().set_index("key")["y_pred"].sort_index()
    want = np.zeros(60)
    for f in range(4):
        want[fold == f] = ridge_fit(x[fold != f], y[fold != f], alpha)(x[fold == f])
    np.testing.assert_allclose(got, want, rtol=1e-8)


def test_centre_is_the_mean_of_all_rows(spark):
    """Also of sorted rows with a drift, whose first 256 are far from the rest."""
    df = spark.range(0, 2000, 1, 4).select(F.array(F.lit(1.0), F.col("id").cast("double")).alias("z"))
    np.testing.assert_allclose(G.near_mean(df), [1.0, 999.5])


def test_loo_equals_refits(data):
    x, y, _, _, df = data
    got = M.loo_closed_form(df, "key", "x", "y").toPandas().set_index("key")["y_pred"].sort_index()
    want = [ridge_fit(np.delete(x, i, 0), np.delete(y, i), 0)(x[i]) for i in range(60)]
    np.testing.assert_allclose(got, want, rtol=1e-7)


def test_ridge_alpha_by_loo_error(data):
    x, y, fold, _, df = data
    g = M.fold_grams(df, "x", ["y"])
    errs = M.ridge_loo_errors(df, "x", "y", "fold", g)
    xt, yt = x[fold != 0], y[fold != 0]
    z = (xt - xt.mean(0)) / xt.std(0)
    for i in (0, 12, 24):
        a = z.T @ z + RIDGE_ALPHAS[i] * np.eye(5)
        h = 1 / len(yt) + np.einsum("ij,jk,ik->i", z, np.linalg.inv(a), z)
        e = (yt - yt.mean() - z @ np.linalg.solve(a, z.T @ (yt - yt.mean()))) / (1 - h)
        assert errs[0][i] == pytest.approx((e ** 2).sum(), rel=1e-6)


def test_held_out_scores_need_no_scoring_pass(data):
    _, _, _, _, df = data
    scores = S.permutation_scores(df, "key", "x", "y", "fold", perms=30)
    direct = M.r2(M.linear_cv(df, "key", "x", "y")).first()["R2"]
    assert scores["R2"][0] == pytest.approx(direct, rel=1e-8)
    assert S.permutation_p(scores["R2"]) == pytest.approx(1 / 31)
    assert S.permutation_p(scores["RMSE"], greater=False) == pytest.approx(1 / 31)


def test_classifier_scores_equal_refits(data):
    """Out-of-fold scores, AUROC and F1 of every permuted label, each tuned by leave-one-out error in its own fold."""
    x, y, fold, _, df = data
    labelled = df.withColumn("y", (F.col("y") > float(np.median(y))).cast("int"))
    got = durable(S.permuted_classifier(labelled, "key", "x", "y", "fold", 6))
    scores = S.classifier_scores(got, 6)
    perm = np.array(S.permuted_labels(labelled, "key", "y", 6).toPandas().sort_values("key")["y_perm"].tolist())
    for b, ys in enumerate([(y > np.median(y)).astype(float), *perm.T]):
        p = np.zeros(60)
        for f in range(4):
            xt, yt = x[fold != f], ys[fold != f]
            z = (xt - xt.mean(0)) / xt.std(0)
            errs = []
            for a in RIDGE_ALPHAS:
                h = 1 / len(yt) + np.einsum("ij,jk,ik->i", z, np.linalg.inv(z.T @ z + a * np.eye(5)), z)
                errs.append((((yt - ridge_fit(xt, yt, a)(xt)) / (1 - h)) ** 2).sum())
            p[fold == f] = ridge_fit(xt, yt, RIDGE_ALPHAS[int(np.argmin(errs))])(x[fold == f])
        mine = got.where(F.col("perm") == b).toPandas()
        np.testing.assert_allclose(np.sort(mine["y_pred"]), np.sort(p), atol=1e-8)
        wins = p[ys == 1][:, None] - p[ys == 0][None, :]
        assert scores["AUROC"][b] == pytest.approx(np.mean((wins > 1e-12) + 0.5 * (np.abs(wins) <= 1e-12)), abs=2e-3)
        hard = p >= 0.5
        f1 = np.mean([2 * np.sum((ys == c) & (hard == c)) / (np.sum(ys == c) + np.sum(hard == c)) for c in (0, 1)])
        assert scores["F1"][b] == pytest.approx(f1)
    assert S.permutation_p(scores["AUROC"]) == pytest.approx(1 / 7)


def test_evaluation_has_both_tasks(spark):
    from meridia.plans.model_queries import catalog

    got = catalog.queries["evaluate_model"](spark, "/root/testdata/sf0.001").toPandas().set_index("metric")
    assert {"R2", "RMSE", "Pearson", "AUROC", "F1"} <= set(got.index)
    assert (got.loc[["AUROC", "F1"], "lo"] <= got.loc[["AUROC", "F1"], "hi"]).all() and got["p"].between(0.01, 1).all()


def test_permuted_labels_are_permutations(spark, data, group_mode):
    _, y, _, _, df = data
    got = S.permuted_labels(df, "key", "y", 3).toPandas()
    arrays = np.array(got["y_perm"].tolist())
    for b in range(3):
        np.testing.assert_allclose(np.sort(arrays[:, b]), np.sort(y))
    assert not np.allclose(arrays[:, 0], arrays[:, 1])


def test_elastic_net_meets_optimality(data):
    x, y, fold, _, df = data
    g = M.fold_grams(df, "x", ["y"])
    mo = M.train_moments(g, 0)
    a, r = 0.3, 0.5
    coef = G.elastic_net(mo, np.array([a]), np.array([r]))[1:, 0] * mo.sd
    xt, yt = x[fold != 0], y[fold != 0]
    z = (xt - xt.mean(0)) / xt.std(0)
    grad = -z.T @ (yt - yt.mean() - z @ coef) / len(yt) + a * (1 - r) * coef
    for b, d in zip(coef, grad):
        assert abs(d) <= a * r + 1e-6 if b == 0 else abs(d + a * r * np.sign(b)) < 1e-5


def test_elastic_net_converges_or_says_so():
    """Strongly correlated features need more than 500 sweeps at a small penalty."""
    cov = np.array([[1.0, 0.999, 1.0], [0.999, 1.0, 0.5], [1.0, 0.5, 50.0]])
    mo = G.Moments(100.0, np.zeros(3), cov, 2)
    coef = G.elastic_net(mo, np.array([1e-4]), np.array([0.5]))[1:, 0]
    grad = cov[:2, :2] @ coef - cov[:2, 2] + 0.5e-4 * coef + 0.5e-4 * np.sign(coef)
    assert np.abs(grad).max() < 1e-6
    with pytest.raises(ValueError, match="not converged"):
        G.elastic_net(mo, np.array([1e-4]), np.array([0.5]), sweeps=500)


def test_folds(spark, group_mode):
    df = spark.createDataFrame([(i, f"g{i // 3}") for i in range(12)], "id int, g string")
    held = M.assign_folds(df, "id", "group", group="g").groupBy("fold").agg(F.count("*").alias("n"), F.countDistinct("g").alias("k")).collect()
    assert len(held) == 4 and all((r["n"], r["k"]) == (3, 1) for r in held)
    assert sorted(r["fold"] for r in M.assign_folds(df, "id").collect()) == list(range(12))
    sizes = [r["count"] for r in M.assign_folds(df, "id", "kfold", k=4).groupBy("fold").count().collect()]
    assert sizes == [3, 3, 3, 3]


def test_bootstrap_brackets_the_point(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(size=200)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "p": y + 0.3 * rng.normal(size=200)}))
    for row in S.intervals(S.bootstrap_regression(df, "y", "p", reps=300)).collect():
        assert row["lo"] <= row["point"] <= row["hi"]
    # scores on a coarse grid, so that ties count by half; three of seven rows are cases
    case = np.arange(140) % 7 < 3
    score = np.round(rng.uniform(size=140) ** np.where(case, 0.5, 2.0), 1)
    rows = spark.createDataFrame(pd.DataFrame({"y": case.astype(int), "p": score}))
    got = {r["metric"]: r for r in S.intervals(S.bootstrap_classification(rows, "y", "p", reps=150)).collect()}
    gaps = score[case][:, None] - score[~case][None, :]
    area = (np.sum(gaps > 0) + np.sum(gaps == 0) / 2) / gaps.size
    assert got["AUROC"]["point"] == pytest.approx(area) and got["AUROC"]["lo"] < area < got["AUROC"]["hi"]
    # the percentile interval is about as wide as the usual standard error of the area says
    spread = np.sqrt((np.var(np.mean(np.sign(gaps) / 2, axis=1), ddof=1) / case.sum()) + (np.var(np.mean(np.sign(gaps) / 2, axis=0), ddof=1) / (~case).sum()))
    assert got["AUROC"]["hi"] - got["AUROC"]["lo"] == pytest.approx(2 * 1.96 * spread, rel=0.35)


def test_poisson_weights_have_unit_mean_and_variance():
    w = S.poisson_weights(np.arange(400), np.ones(400), 500, 0)
    assert w.mean() == pytest.approx(1, abs=0.02) and w.var() == pytest.approx(1, abs=0.05)
    assert S.poisson_weights(np.arange(50), np.full(50, 80.0), 300, 0).mean() == pytest.approx(80, rel=0.02)


def test_mean_baseline_and_nested(spark, data):
    _, y, _, _, df = data
    loo = (y.sum() - y) / 59
    want = 1 - ((y - loo) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert S.mean_baseline(df, "y").first()["R2"] == pytest.approx(want)
    got = S.baseline_scores(df, "key", "x", "y")
    assert got["nested"]["R2"] > 0.9 > got["shuffled"]["R2"] and got["random"]["R2"] < 0.3
    assert got["nested"]["R2"] <= got["nonnested"]["R2"] + 0.05


def test_calibration(spark):
    rng = np.random.default_rng(17)
    p = np.round(rng.uniform(0.02, 0.98, 300), 3)
    y = (rng.uniform(size=300) < p ** 2).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "p": p}))
    assert B.brier_score(df, "y", "p").first()[0] == pytest.approx(np.mean((y - p) ** 2))
    box = np.minimum((p * 10).astype(int), 9)
    error = sum((box == k).sum() * abs(p[box == k].mean() - y[box == k].mean()) for k in set(box)) / 300
    assert B.expected_calibration_error(df, "y", "p").first()[0] == pytest.approx(error)
    tied = spark.createDataFrame([(4.5, 1.25)] * 3 + [(0.5, 1.25)], "y double, p double")
    assert B.regression_bins(tied, "y", "p").first()["n"] == 4


def test_consensus_finds_the_signal(data):
    _, _, _, _, df = data
    summary, freq, preds = L.consensus_panel(df, "key", NAMES)
    got = {r["feature"]: r["in_frozen_set"] for r in freq.collect()}
    assert got["f0"] == 4 and got["f1"] == 4
    assert all(r["external_R2"] > 0.9 for r in summary.collect()) and preds.count() == 180
    assert {"f0", "f1"} <= {r["feature"] for r in L.stable_panel(freq).collect()}


def wide(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(24, 3))
    x = base @ rng.normal(size=(3, 30)) + 0.3 * rng.normal(size=(24, 30))
    x[:, 10] = x[:, 2] * 2 + 1e-3 * rng.normal(size=24)
    x[:, 11] = 5.0
    x[3, 4] = np.nan
    x[:15, 20] = np.nan
    pdf = pd.DataFrame(x, columns=[f"A{i:02d}" for i in range(30)]).rename_axis("subject_id").reset_index().melt("subject_id", var_name="analyte")
    return x, spark.createDataFrame(pdf).withColumn("value", F.when(F.isnan("value"), None).otherwise(F.col("value"))), base


def reduced(x):
    keep = [j for j in range(30) if np.isnan(x[:, j]).mean() <= 0.5 and np.nanvar(x[:, j], ddof=1) > 1e-8]
    z = x[:, keep].copy()
    for j in range(z.shape[1]):
        z[np.isnan(z[:, j]), j] = np.nanmedian(z[:, j])
    r = np.abs(np.corrcoef(z.T))
    alive = np.ones(len(keep), bool)
    for i in range(len(keep)):
        if alive[i]:
            for j in range(i + 1, len(keep)):
                if alive[j] and r[i, j] > 0.95:
                    alive[j] = False
    return z[:, alive], [keep[i] for i in np.flatnonzero(alive)]


def test_leading_axes_equal_a_full_decomposition():
    rng = np.random.default_rng(12)
    for p, k, spectrum in ((70, 10, np.ones(70)), (400, 12, np.linspace(1.0, 0.5, 400)), (300, 5, 0.97 ** np.arange(300)), (40, 4, [5, 5, 5, 1] + [0] * 36), (3, 3, [3, 2, 1])):
        q, _ = np.linalg.qr(rng.normal(size=(p, p)))
        noise = rng.normal(size=(p, p)) * 1e-3
        a = q @ np.diag(spectrum) @ q.T + noise + noise.T
        lam, vec = np.linalg.eigh(a)
        axes, got = H.leading_axes(lambda panel, a=a: a @ panel, p, k)
        np.testing.assert_allclose(got, lam[::-1][:k], rtol=1e-9)
        np.testing.assert_allclose(np.abs(np.sum(axes * vec[:, ::-1][:, :k].T, axis=1)), 1, atol=1e-6)
    with pytest.raises(ValueError, match="not found"):
        H.leading_axes(lambda panel: a @ panel, 3, 1, extra=0, tol=-1, most=0)


def test_panel_product_over_many_blocks(spark):
    rng = np.random.default_rng(13)
    m = rng.normal(size=(21, 21))
    m, panel, wide_m = m + m.T, rng.normal(size=(21, 3)), np.zeros((24, 24))
    wide_m[:21, :21] = m
    rows = [(i, j, [float(v) for v in wide_m[8 * i:8 * i + 8, 8 * j:8 * j + 8].ravel()]) for i in range(3) for j in range(i, 3)]
    blocks = spark.createDataFrame(rows, "b1 int, b2 int, v array<double>").repartition(4)
    np.testing.assert_allclose(H.panel_product(blocks, panel, 8), m @ panel, atol=1e-12)


@pytest.mark.parametrize("subjects", [24, 12])
def test_reduction_matches_numpy(spark, subjects):
    """More subjects than components need, and fewer subjects than features."""
    x, cells, _ = wide(spark)
    x, cells = x[:subjects], cells.where(f"subject_id < {subjects}")
    got = H.fit_reduction(cells, k=4)
    z, kept = reduced(x)
    assert len(kept) > 12
    assert got.trace["after_correlation_prune"] == len(kept) and got.trace["after_prevalence"] == 29
    s = (z - z.mean(0)) / z.std(0)
    u, d, _ = np.linalg.svd(s, full_matrices=False)
    np.testing.assert_allclose(got.explained, (d ** 2 / (d ** 2).sum())[:4], rtol=1e-6)
    scores = got.apply(cells).toPandas().sort_values("subject_id")[[f"omics_pc{i}" for i in range(4)]].to_numpy()
    np.testing.assert_allclose(np.abs(scores), np.abs(u[:, :4] * d[:4]), rtol=1e-5, atol=1e-7)


def test_block_route_equals_one_block(spark):
    x, cells, _ = wide(spark)
    full = cells.where("analyte not in ('A11', 'A20')")
    stats = durable(H.feature_stats(full, 24))
    base = H.base_values(stats)
    one = H.correlation_pairs(H.block_products(full, stats), base, 24).toPandas().sort_values(["a", "b"])["r"].to_numpy()
    many = H.correlation_pairs(H.block_products(full, stats, 8), base, 24, block=8).toPandas().sort_values(["a", "b"])["r"].to_numpy()
    np.testing.assert_allclose(one, many, atol=1e-9)


def test_wide_cross_validation_is_a_refit_per_fold(spark):
    x, cells, base = wide(spark)
    y = base[:, 0] + 0.1 * np.arange(24)
    labels = durable(spark.createDataFrame([(i, float(y[i]), i % 2) for i in range(24)], "subject_id long, y double, fold int"))
    preds, trace = H.highdim_cv(durable(cells), labels, "fold", k=3)
    got = {(r.model, r.subject_id): r.y_pred for r in preds.collect()}
    assert len(got) == 48 and {m for m, _ in got} == {"ridge", "boosted"}
    alphas = {r.fold: r.alpha for r in trace.collect()}
    for f in (0, 1):
        fitted = H.fit_reduction(cells.where(f"subject_id % 2 <> {f}"), k=3)
        z = fitted.apply(cells).toPandas().sort_values("subject_id")[[f"omics_pc{i}" for i in range(3)]].to_numpy()
        train = np.arange(24) % 2 != f
        mean, sd = z[train].mean(axis=0), z[train].std(axis=0)
        s = (z - mean) / sd
        beta = np.linalg.solve(s[train].T @ s[train] + alphas[f] * np.eye(3), s[train].T @ (y[train] - y[train].mean()))
        for i in np.flatnonzero(~train):
            assert got["ridge", i] == pytest.approx(y[train].mean() + s[i] @ beta, abs=1e-6)
            reach = np.ptp(y[train]) / 4  # the trees' sum may leave the range of the train labels a little
            assert y[train].min() - reach <= got["boosted", i] <= y[train].max() + reach


def test_greedy_drop_is_the_ordered_scan(spark):
    rng = np.random.default_rng(9)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 25, (60, 2)) if a < b})
    alive = np.ones(25, bool)
    for i in range(25):
        if alive[i]:
            for a, b in pairs:
                if a == i:
                    alive[b] = False
    df = spark.createDataFrame(pairs, "a bigint, b bigint").repartition(3)
    for width in (H.RANGE, 7):
        assert {r["idx"] for r in H.greedy_drop(df, width).collect()} == set(np.flatnonzero(~alive).tolist())
    assert H.greedy_drop(df.limit(0)).isEmpty()


def test_greedy_drop_of_a_chain_takes_a_job_a_range(spark):
    chain = spark.range(4999).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert sorted(r["idx"] for r in H.greedy_drop(chain).collect()) == list(range(1, 5000, 2))


def test_reduction_ignores_held_out_rows(spark):
    _, cells, _ = wide(spark)
    train = cells.where("subject_id % 3 <> 0")
    changed = cells.withColumn("value", F.when(F.col("subject_id") % 3 == 0, F.col("value") * 100).otherwise(F.col("value")))
    a = H.fit_reduction(train, k=3)
    b = H.fit_reduction(changed.where("subject_id % 3 <> 0"), k=3)
    np.testing.assert_allclose(a.explained, b.explained)
    assert a.apply(cells.where("subject_id = 0").unionByName(spark.createDataFrame([(0, "unknown", 9.0)], "subject_id long, analyte string, value double"))).count() == 1


def test_resample_lengths(spark, group_mode):
    from meridia.operators import glucose as Q

    rng = np.random.default_rng(0)
    traces = {"long": rng.normal(size=1300), "same": rng.normal(size=64), "short": rng.normal(size=30), "one": np.array([5.0])}
    rows = [(s, pd.Timestamp("2020-01-01") + pd.Timedelta(minutes=i), float(v), i) for s, vs in traces.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["s", "t", "v", "n"]))
    everyone = spark.createDataFrame([(s,) for s in [*traces, "none"]], "subject_id string")
    got = Z.as_vectors(Z.resample_to_length(Q.trace(Q.clean_series(df, "s", "v", "t", "n")), everyone, 64)).toPandas().set_index("subject_id")["x"]
    assert all(len(v) == 64 for v in got) and len(got) == 5
    e = np.trunc(np.linspace(0, 1300, 65)).astype(int)
    np.testing.assert_allclose(got["long"], [traces["long"][a:b].mean() for a, b in zip(e, e[1:])])
    np.testing.assert_allclose(got["same"], traces["same"])
    np.testing.assert_allclose(got["short"], np.interp(np.linspace(0, 1, 64), np.linspace(0, 1, 30), traces["short"]))
    assert set(got["one"]) == {5.0} and set(got["none"]) == {0.0}


def test_transforms(spark, group_mode):
    rng = np.random.default_rng(2)
    v = np.round(rng.lognormal(0, 1.5, 120), 2)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(120), "v": v, "c": 1.0}))

    def run(name):
        return T.apply_transform(name, df, ["v", "c"]).toPandas().sort_values("id")

    np.testing.assert_allclose(run("standard")["v"], (v - v.mean()) / v.std())
    q = np.percentile(v, [25, 50, 75])
    np.testing.assert_allclose(run("robust")["v"], (v - q[1]) / (q[2] - q[0]))
    for name in T.TRANSFORMS:
        got = run(name)
        assert got.shape == (120, 3) and np.isfinite(got["v"]).all()
    ranks = run("quantile")["v"].rank()
    np.testing.assert_allclose(ranks, pd.Series(v).rank())
    lam = T.power_lambdas(df, ["v"])["v"]
    def ll(m):
        t = ((v + 1) ** m - 1) / m
        return -60 * np.log(t.var()) + (m - 1) * np.log1p(v).sum()
    assert ll(lam) >= max(ll(lam + 1e-3), ll(lam - 1e-3))
    with pytest.raises(ValueError):
        T.apply_transform("other", df, ["v"])


def test_icc_published_table(spark):
    """Ratings of Shrout and Fleiss (1979): ICC(2,1) = 0.29, ICC(2,k) = 0.62."""
    rows = [(9, 2, 5, 8), (6, 1, 3, 2), (8, 4, 6, 8), (7, 1, 2, 6), (10, 5, 6, 9), (6, 2, 4, 7)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "a double, b double, c double, d double")
    one, many = I.icc(df, list("abcd")).first(), I.icc(df, list("abcd"), "ICC(2,k)").first()
    assert round(one["icc"], 2) == 0.29 and round(many["icc"], 2) == 0.62
    assert round(one["ci_lo"], 2) == 0.02 and round(one["ci_hi"], 2) == 0.76
    with pytest.raises(ValueError):
        I.icc(df, ["a"])
    with pytest.raises(ValueError):
        I.icc(df, list("abcd"), "ICC(3,1)")
    with pytest.raises(ValueError):
        I.icc(df.withColumn("a", F.lit(float("nan"))), list("abcd"))


def test_special_functions():
    assert special.f_quantile(0.95, 3, 10) == pytest.approx(3.7083, abs=1e-3)
    assert special.critical_correlation(20) == pytest.approx(0.4438, abs=1e-3)


def test_gaussian_mechanism(spark):
    for eps in (0.1, 1.0, 5.0):
        s = V.analytic_sigma(1.0, eps, 1e-5)
        assert V.privacy_loss(s, 1.0, eps) == pytest.approx(1e-5, abs=1e-9)
    assert V.analytic_sigma(1.0, 0.5, 1e-5) < V.classic_sigma(1.0, 0.5, 1e-5)
    assert V.analytic_sigma(2.0, math.inf, 1e-5) == 0.0
    for bad in ((0, 1e-5), (1, 0), (1, 1)):
        with pytest.raises(ValueError):
            V.classic_sigma(1.0, *bad)
    df = spark.createDataFrame([(float(i), "g") for i in range(11)], "v double, g string")
    assert V.dp_mean(df, "v", math.inf, 1e-5, 0, 5, keys=["g"]).first()["dp_mean"] == pytest.approx(np.minimum(np.arange(11), 5).mean())
    a, b = (V.dp_mean(df, "v", 1.0, 1e-5, 0, 5, keys=["g"], seed=3).first()["dp_mean"] for _ in range(2))
    assert a == b
    with pytest.raises(ValueError):
        V.dp_mean(df, "v", 1.0, 1e-5, 5, 5)


def test_site_average_and_fit(spark):
    sites = spark.createDataFrame([([0.0], 3), ([4.0], 1)], "params array<double>, n bigint")
    assert V.weighted_param_average(sites).first()["value"] == 1.0
    with pytest.raises(ValueError):
        V.weighted_param_average(spark.createDataFrame([([0.0], 3), ([4.0, 1.0], 1)], "params array<double>, n bigint"))
    rng = np.random.default_rng(0)
    x = rng.normal(size=(240, 3))
    y = (x[:, 0] - x[:, 1] + 0.3 * rng.normal(size=240) > 0).astype(int)
    site = np.where(y[:] * (np.arange(240) % 7 == 0) == 1, 9, np.arange(240) % 3)  # site 9 has one class
    df = spark.createDataFrame(pd.DataFrame({"key": np.arange(240), "site": site, "x": list(x), "y": y}))
    got = V.site_partitioned_fit(df, "key", "site", "x", "y", rounds=3).orderBy("round").collect()
    assert len(got) == 3 and got[-1]["central_score"] > 0.85 and abs(got[-1]["gap"]) < 0.1
    z = durable(df.select("site", F.concat(F.array(F.lit(1.0)), "x", F.array(F.col("y").cast("double"))).alias("z")))
    local, pooled = V.fit_sites(z, "site", 3)
    for s, coef in [*local.items(), (None, pooled)]:
        rows = np.ones(240, bool) if s is None else site == s
        a = np.column_stack([np.ones(rows.sum()), x[rows]])
        grad = a.T @ (1 / (1 + np.exp(-a @ coef)) - y[rows]) + np.r_[0, coef[1:]]
        if s != 9:
            assert np.abs(grad).max() < 1e-5


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_site_models_inside_tasks_and_summed(spark, task):
    """A site's model is the same whether one task fits it or all tasks sum it; one-class and NULL sites have their place."""
    rng = np.random.default_rng(41)
    x = rng.normal(size=(300, 2))
    y = (x @ [1.5, -1.0] + rng.normal(size=300) > 0).astype(float) if task == "classification" else x @ [2.0, 1.0] + 3 + rng.normal(size=300)
    names = [None if i % 5 == 4 else f"s{i % 5}" for i in range(300)]
    names = ["flat" if s == "s3" and y[i] == 1 else s for i, s in enumerate(names)]
    rows = durable(spark.createDataFrame([(s, [1.0, *map(float, r), float(t)]) for s, r, t in zip(names, x, y)], "site string, z array<double>"))
    one, other = ({r.site: (r.n, r.coef) for r in V.site_models(rows, 2, task, most).collect()} for most in (10**6, 50))
    assert set(one) == set(other) == set(names)
    for s, (n, coef) in one.items():
        mine = np.array([t == s for t in names])
        assert n == other[s][0] == mine.sum()
        if task == "classification" and len(set(y[mine])) == 1:
            assert coef is None and other[s][1] is None
            continue
        np.testing.assert_allclose(coef, other[s][1], atol=1e-7)
        if task == "regression":
            a = x[mine] - x[mine].mean(axis=0)
            beta = np.linalg.solve(a.T @ a + np.eye(2), a.T @ (y[mine] - y[mine].mean()))
            np.testing.assert_allclose(coef[1:], beta, atol=1e-8)


def test_attribution_adds_up(spark):
    """A step and a slope carry the outcome; two coin flips and a copy of nothing do not."""
    rng = np.random.default_rng(21)
    slope, gate = rng.uniform(-2, 2, 360), rng.integers(0, 2, 360)
    x = np.column_stack([rng.integers(0, 2, (360, 2)), gate, np.zeros(360), slope])
    y = 8.0 * gate + 3.0 * slope
    df = durable(spark.createDataFrame(pd.DataFrame({"key": np.arange(360), "x": list(x), "y": y})))
    model = X.fit_boosted(df, "x", "y", maxIter=6)
    rows = durable(X.tree_attribution(model, df, "key", "x"))
    want = model.transform(M.with_features(df, "x")).select("key", F.col("prediction").alias("p"))
    assert rows.join(want, "key").agg(F.max(F.abs(F.col("prediction") - F.col("p")))).first()[0] < 1e-9
    ranking = {r["analyte"]: r["mean_abs"] for r in X.attribution_ranking(rows, ["coin1", "coin2", "gate", "blank", "slope"]).collect()}
    assert min(ranking["gate"], ranking["slope"]) > 10 * max(ranking["coin1"], ranking["coin2"]) and not ranking.get("blank")
    assert sum(r["gain"] for r in X.gain_importance(model, ["coin1", "coin2", "gate", "blank", "slope"], spark).collect()) == pytest.approx(1)
    curve = X.ale_1d(model, df, "x", 4).orderBy("edge").toPandas()
    assert curve["effect"].iloc[-1] - curve["effect"].iloc[0] > 8 and curve["n"].sum() == 360


def by_enumeration(tree, x, features):
    """Shapley values of one tree and row by all subsets of its features."""
    def worth(known, node=0):
        f = tree["feature"][node]
        if f < 0:
            return tree["value"][node]
        lo, hi = tree["left"][node], tree["right"][node]
        if f in known:
            return worth(known, lo if x[f] <= tree["cut"][node] else hi)
        return (worth(known, lo) * tree["cover"][lo] + worth(known, hi) * tree["cover"][hi]) / tree["cover"][node]

    used = sorted({f for f in tree["feature"] if f >= 0})
    phi = np.zeros(features)
    for f in used:
        rest = [u for u in used if u != f]
        for size in range(len(used)):
            for s in itertools.combinations(rest, size):
                w = math.factorial(size) * math.factorial(len(used) - size - 1) / math.factorial(len(used))
                phi[f] += w * (worth({*s, f}) - worth(set(s)))
    return tree["weight"] * phi, tree["weight"] * worth(set())


def random_tree(rng, depth, features):
    tree = {k: [] for k in ("feature", "cut", "left", "right", "value", "cover")} | {"weight": 0.7}

    def grow(d, cover):
        at = len(tree["feature"])
        for k in ("feature", "cut", "left", "right", "value"):
            tree[k].append(-1 if k == "feature" else 0)
        tree["cover"].append(cover)
        tree["value"][at] = float(rng.normal())
        if d and cover > 1:
            part = int(rng.integers(1, cover))
            tree["feature"][at], tree["cut"][at] = int(rng.integers(features)), float(rng.normal())
            tree["left"][at] = grow(d - 1, part)
            tree["right"][at] = grow(d - 1, cover - part)
        return at

    grow(depth, 500)
    return tree


def test_attribution_by_paths_equals_enumeration():
    """Trees that split on one feature again and again, rows on the cuts and beyond them, missing values."""
    rng = np.random.default_rng(31)
    for depth, features in ((3, 4), (4, 3), (5, 8), (1, 2), (0, 2)):
        tree = random_tree(rng, depth, features)
        x = rng.normal(size=(12, features))
        x[0, 0] = np.nan
        if tree["feature"][0] >= 0:
            x[1, tree["feature"][0]] = tree["cut"][0]
        got = np.zeros_like(x)
        base = X.shapley_of_tree(tree, x, got)
        for i, row in enumerate(x):
            phi, expected = by_enumeration(tree, row, features)
            np.testing.assert_allclose(got[i], phi, atol=1e-10)
            assert base == pytest.approx(expected)


def test_attribution_of_deep_trees(spark):
    """Depth 6 over 40 features: the values still add up to the model's own predictions."""
    rng = np.random.default_rng(32)
    x = rng.normal(size=(500, 40))
    df = durable(spark.createDataFrame(pd.DataFrame({"key": np.arange(500), "x": list(x), "y": np.sin(3 * x[:, :8]).sum(axis=1)})))
    model = X.fit_boosted(df, "x", "y", maxIter=3, maxDepth=6)
    rows = X.tree_attribution(model, df, "key", "x")
    want = model.transform(M.with_features(df, "x")).select("key", F.col("prediction").alias("p"))
    assert rows.join(want, "key").agg(F.max(F.abs(F.col("prediction") - F.col("p")))).first()[0] < 1e-9


def test_ale_of_a_rare_valued_feature(spark):
    """Fewer than three quantile edges: every distinct value becomes an edge."""
    x0 = np.r_[np.zeros(190), np.linspace(1, 2, 10)]
    rng = np.random.default_rng(0)
    df = durable(spark.createDataFrame(pd.DataFrame({"key": np.arange(200), "x": list(np.column_stack([x0, rng.normal(size=200)])), "y": x0 * 3})))
    model = X.fit_boosted(df, "x", "y", maxIter=3)
    curve = X.ale_1d(model, df, "x", 0).orderBy("edge").toPandas()
    assert len(curve) == 11 and curve["n"].sum() == 200


def test_ale_of_every_feature(spark):
    """The query has a curve for all 64 entries, among them the third, which carries the label; equal to a plain count."""
    from meridia.plans.advanced_queries import NAMES as ALL
    from meridia.plans.advanced_queries import boosted, catalog

    sf = "/root/testdata/sf0.001"
    got = catalog.queries["ale_1d"](spark, sf).toPandas()
    assert set(got["feature"]) == set(ALL)
    df, model = boosted(spark, sf)
    pdf = df.toPandas()
    rows = np.array(pdf["x"].tolist(), float)
    assert (got.groupby("feature")["n"].sum() == len(rows)).all()
    v = rows[:, 2]
    edges = np.unique(np.quantile(v, np.linspace(0, 1, 11)))
    at = np.clip(np.searchsorted(edges, v, side="right") - 1, 0, len(edges) - 2)
    sides = []
    for up in (0, 1):
        moved = rows.copy()
        moved[:, 2] = edges[at + up]
        part = spark.createDataFrame(pd.DataFrame({"i": np.arange(len(rows)), "x": list(moved)}))
        sides.append(model.transform(M.with_features(part, "x")).orderBy("i").toPandas()["prediction"].to_numpy())
    n = np.bincount(at, minlength=len(edges) - 1)
    step = np.bincount(at, sides[1] - sides[0], len(edges) - 1) / np.maximum(n, 1)
    curve = np.r_[0, np.cumsum(step)]
    curve -= np.sum(n * (curve[:-1] + curve[1:]) / 2) / n.sum()
    mine = got[got["feature"] == ALL[2]].sort_values("edge")
    np.testing.assert_allclose(mine["edge"], edges, atol=1e-5)
    np.testing.assert_allclose(mine["effect"], curve, atol=1e-4)


def test_fusion_controls(spark):
    rng = np.random.default_rng(8)
    z = rng.normal(size=150)
    block = {m: list((z[:, None] * w + rng.normal(size=(150, k)))) for m, k, w in (("omics", 6, 1.0), ("cgm", 4, 1.0))}
    df = durable(spark.createDataFrame(pd.DataFrame({"key": np.arange(150), "y": z, "fold": np.arange(150) % 3, **block})))
    mixed = U.block_permute(df, "key", ["omics", "cgm"]).toPandas()
    for m in ("omics", "cgm"):
        a, b = np.array(mixed[m].tolist()), np.array(block[m])
        np.testing.assert_allclose(np.sort(a[:, 0]), np.sort(b[:, 0]))
    table, verdict = U.fusion_controls(df, "key", ["omics", "cgm"], trees=20)
    got = {r["model"]: r["R2"] for r in table.collect()}
    assert got["fusion on scrambled"] < 0.2 < got["fusion"] and verdict["scramble_advantage_vanishes"]
    load = {r["modality"]: r["loading"] for r in U.shared_component_loading(
        {"omics": df.select("key", F.col("omics").alias("x")), "cgm": None}, "key", {"cgm": 0.7}).collect()}
    assert 0.1 <= load["omics"] <= 1.5 and load["cgm"] == 0.7


def test_scoring_contract_and_reload(spark, data):
    x, y, _, _, df = data
    wide = df.select("key", "y", *[F.col("x")[i].alias(n) for i, n in enumerate(NAMES)])
    model = C.fit_scoring_model(wide, NAMES, "y")
    path = scratch_path(spark, "model")
    model.save(spark, path)
    again = C.ScoringModel.load(spark, path)
    assert again.features == NAMES and again.coef == model.coef
    preds = again.score(wide.select("key", *NAMES), ["key"]).toPandas().sort_values("key")
    assert np.corrcoef(preds["prediction"], y)[0, 1] > 0.99 and set(preds["n_features"]) == {5}
    with pytest.raises(ValueError, match="expected 5 features"):
        model.score(wide.select("key", *NAMES[::-1]), ["key"])


def test_streams_reuse_the_batch_operators(spark, data):
    from meridia.streaming.live import live_minutes, live_scores

    rows = [("s", f"2020-01-01 00:0{i // 6}:{10 * (i % 6):02d}", 60.0 + i) for i in range(30)] + [("s", "2020-01-01 02:00:00", 1.0)]
    folder = scratch_path(spark, "stream")
    spark.createDataFrame(rows, "subject_id string, t string, hr double").select("subject_id", F.to_timestamp("t").alias("ts"), "hr").write.parquet(folder)
    live = spark.readStream.schema("subject_id string, ts timestamp, hr double").parquet(folder)
    q = live_minutes(live, ["hr"]).writeStream.format("memory").queryName("mins").outputMode("append").option(
        "checkpointLocation", scratch_path(spark, "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select * from mins").count() == 5  # the open last minute waits for the watermark
    scored = live_scores(live.select("subject_id", "hr"), C.ScoringModel("m", ["hr"], [1.0, 2.0]), ["subject_id"])
    assert scored.isStreaming


def test_power_works_on_distinct_values(spark):
    """Exponents and the result come from counted values; repeated rows weigh as often as they occur."""
    v = np.repeat(np.random.default_rng(5).gamma(2.0, 3.0, 300).round(1), np.arange(300) % 4 + 1)
    df = spark.createDataFrame([(float(x), 1.0) for x in v], "v double, flat double")
    assert T.counted(df, ["v", "flat"]).count() == len(set(v)) + 1
    lam = T.power_lambdas(df, ["v"])["v"]

    def ll(m):
        return -len(v) / 2 * np.log((((v + 1) ** m - 1) / m).var()) + (m - 1) * np.log1p(v).sum()

    assert ll(lam) >= max(ll(lam + 1e-3), ll(lam - 1e-3))
    want = ((v + 1) ** lam - 1) / lam
    rows = T.power(df, ["v", "flat"]).collect()
    np.testing.assert_allclose(np.sort([r.v for r in rows]), np.sort((want - want.mean()) / want.std()), atol=1e-9)
    assert {r.flat for r in rows} == {0.0}


def test_rows_are_made_dense_in_bounded_batches(spark):
    from meridia.operators import gram

    df = spark.range(0, 5000, 1, 1).select(F.lit(1).alias("c"), F.array(F.col("id").cast("double")).alias("z"))
    parts = gram.summed(df, ["c"], lambda z: np.array([z.sum(), len(z), float(len(z) > 1024)])).collect()
    assert np.sum([r.v for r in parts], axis=0).tolist() == [5000 * 4999 / 2, 5000.0, 0.0]
