import numpy as np
from pyspark.sql import functions as F

from meridia.operators import models as M
from meridia.operators import series as Z


def resampled(spark, rows):
    """rows: subject -> values."""
    flat = [(s, t, float(v)) for s, x in rows.items() for t, v in enumerate(x)]
    return spark.createDataFrame(flat, "subject_id long, t int, v double").repartition(3)


def brute(x, kernels):
    x = np.asarray(x, float)
    x = np.zeros(len(x)) if x.std() <= 0 else (x - x.mean()) / x.std()
    out = []
    for w, bias, step, padded in zip(kernels.weights, kernels.biases, kernels.dilations, kernels.padded, strict=True):
        edge = (len(w) - 1) * step // 2 if padded else 0
        z = [0.0] * edge + list(x) + [0.0] * edge
        got = [bias + sum(w[j] * z[i + j * step] for j in range(len(w))) for i in range(len(z) - (len(w) - 1) * step)]
        out += [sum(v > 0 for v in got) / len(got), max(got)]
    return out


def test_kernels_against_loops_and_independent_of_others(spark):
    rng = np.random.default_rng(5)
    rows = {s: rng.normal(size=48).cumsum() for s in range(9)} | {9: np.full(48, 3.0)}
    kernels = Z.Kernels.draw(48, 20, seed=3)
    assert len(set(kernels.dilations)) > 2 and set(kernels.padded) == {True, False}
    vectors = {r[0]: r[1:] for r in Z.series_embedding(resampled(spark, rows), 48, 20, seed=3).collect()}
    assert len(vectors) == 10
    for s, x in rows.items():
        np.testing.assert_allclose(vectors[s], brute(x, kernels), atol=1e-9)
    alone = {r[0]: r[1:] for r in Z.series_embedding(resampled(spark, {4: rows[4]}), 48, 20, seed=3).collect()}
    assert alone[4] == vectors[4]
    assert Z.series_embedding(resampled(spark, rows).limit(0), 48, 20).count() == 0


def test_short_series_and_own_model(spark):
    rows = {1: [1.0, 2.0, 4.0], 2: [0.0, 0.0, 0.0]}
    got = Z.series_embedding(resampled(spark, rows), 3, 6).collect()
    assert all(np.isfinite(r[1:]).all() for r in got)
    own = Z.series_embedding(resampled(spark, rows), scorer=lambda x: x[:, :2], k=2).where("subject_id = 2").first()
    assert tuple(own) == (2, 0.0, 0.0)


def test_ridge_leave_one_out_is_a_refit(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(25, 6)) * [1, 10, 0.1, 3, 1, 1] + 5
    x[:, 5] = x[:, 4] * 2
    y = x[:, 0] - x[:, 1] + rng.normal(size=25)
    df = spark.createDataFrame([(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))], "k long, x array<double>, y double")
    got = {r.k: r for r in M.ridge_loo(df.repartition(4), "k", "x", "y", 1.7).collect()}
    weights = 1.7 * np.var(x, axis=0)
    for i in range(25):
        rest = np.arange(25) != i
        mx, my = x[rest].mean(axis=0), y[rest].mean()
        beta = np.linalg.solve((x[rest] - mx).T @ (x[rest] - mx) + np.diag(weights), (x[rest] - mx).T @ (y[rest] - my))
        assert abs(got[i].y_pred - (my + (x[i] - mx) @ beta)) < 1e-8


def test_resampled_series_have_one_vector_each(spark):
    placed = spark.createDataFrame([(1, 1, 2, 5.0, 9.0), (1, 2, 2, 9.0, None)], "subject_id long, pos long, n long, g double, g_next double")
    everyone = spark.createDataFrame([(1,), (2,)], "subject_id long")
    vectors = Z.series_embedding(Z.resample_to_length(placed, everyone, length=16), 16, 4)
    assert vectors.agg(F.count("*"), F.count("ts7")).first() == (2, 2)
