"""Cross-validated models, scores, resampling and calibration."""

from pyspark.sql import functions as F

from meridia.operators import calibration as B
from meridia.operators import metrics as E
from meridia.operators import models as M
from meridia.operators import resampling as S
from meridia.plans.catalog import Catalog, report_sql, rounded
from meridia.plans.tables import ORDER_SQL, SCORE_SQL, order_totals, predictions, risks, table, vectors
from meridia.session import durable

catalog = Catalog()
add = catalog.add


@add("assign_folds", """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS loo,
  dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS fold FROM orders""")
def _folds(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    loo = M.assign_folds(orders, "o_orderkey").withColumnRenamed("fold", "loo")
    return M.assign_folds(loo, "o_orderkey", "group", group="o_orderpriority").select("o_orderkey", "loo", "fold")


@add("assign_folds_shuffled")
def _kfold(spark, sf):
    return M.assign_folds(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", "kfold", k=5)


@add("linear_cv", report_sql(ORDER_SQL + """,
fits AS (SELECT f, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM t JOIN (SELECT DISTINCT fold AS f FROM t) ON fold <> f GROUP BY 1)""",
"SELECT key, fold, y AS y_true, a + b * x AS y_pred FROM t JOIN fits ON f = fold", "y_true y_pred", 4))
def _linear(spark, sf):
    return rounded(M.linear_cv(order_totals(spark, sf), "key", "x", "y"), 4)


@add("linear_cv_vectors")
def _linear_vectors(spark, sf):
    return rounded(E.regression_metrics(M.linear_cv(vectors(spark, sf), "key", "x", "y", alpha=1.0), "y_true", "y_pred"))


@add("loo_r2_closed_form", report_sql(ORDER_SQL + """,
s AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx, count(*) AS n FROM t),
e AS (SELECT (y - a - b * x) / (1 - 1.0::DOUBLE / n - (x - mx) * (x - mx) / sxx) AS e, y - my AS d FROM t, s)""",
"SELECT 1 - sum(e * e) / sum(d * d) AS R2, count(*) AS n FROM e", "R2"))
def _loo(spark, sf):
    return rounded(M.r2(M.loo_closed_form(order_totals(spark, sf), "key", "x", "y")))


@add("ridge_alpha_path")
def _ridge(spark, sf):
    preds, chosen = M.ridge_path_cv(vectors(spark, sf), "key", "x", "y")
    alphas = spark.createDataFrame(list(chosen.items()), "fold int, alpha double")
    per_fold = E.regression_metrics(preds, "y_true", "y_pred", ["fold"])
    return rounded(per_fold.join(alphas, "fold"))


@add("elasticnet_grid")
def _elastic(spark, sf):
    preds, chosen = M.elasticnet_cv(vectors(spark, sf), "key", "x", "y")
    picks = spark.createDataFrame([(f, a, r) for f, (a, r) in chosen.items()], "fold int, alpha double, l1_ratio double")
    return rounded(E.regression_metrics(preds, "y_true", "y_pred", ["fold"]).join(picks, "fold"))


@add("forest_cv")
def _forest(spark, sf):
    preds = durable(M.tree_cv(vectors(spark, sf), "key", "x", "y", kind="forest"))
    return rounded(E.regression_metrics(preds, "y_true", "y_pred"))


@add("boosted_cv")
def _boosted(spark, sf):
    preds = durable(M.tree_cv(vectors(spark, sf), "key", "x", "y", kind="boosted", maxIter=10))
    return rounded(E.regression_metrics(preds, "y_true", "y_pred"))


@add("grid_search")
def _grid(spark, sf):
    fitted = M.grid_search(vectors(spark, sf), "x", "y", {"maxDepth": [2, 4], "numTrees": [10, 20]}, kind="forest", folds=3)
    return spark.createDataFrame(M.grid_scores(fitted), "params string, mse double")


@add("regression_metrics", report_sql(SCORE_SQL + """,
r AS (SELECT *, rank() OVER (PARTITION BY target ORDER BY y_true) + (count(*) OVER (PARTITION BY target, y_true) - 1) / 2.0::DOUBLE AS ry,
  rank() OVER (PARTITION BY target ORDER BY y_pred) + (count(*) OVER (PARTITION BY target, y_pred) - 1) / 2.0::DOUBLE AS rp FROM preds)""",
"""SELECT target, 1 - avg((y_true - y_pred) * (y_true - y_pred)) / var_pop(y_true) AS R2, avg(abs(y_true - y_pred)) AS MAE,
 sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS RMSE, corr(y_true, y_pred) AS Pearson, corr(ry, rp) AS Spearman FROM r GROUP BY 1""",
"R2 MAE RMSE Pearson Spearman"))
def _regression(spark, sf):
    return rounded(E.regression_metrics(predictions(spark, sf), "y_true", "y_pred", ["target"]))


@add("classification_metrics", report_sql(SCORE_SQL + """,
h AS (SELECT y_true AS t, (y_pred >= 0.5)::INT AS h, y_pred, rank() OVER (ORDER BY y_pred) + (count(*) OVER (PARTITION BY y_pred) - 1) / 2.0::DOUBLE AS r FROM risks),
f AS (SELECT c, 2.0::DOUBLE * count(*) FILTER (WHERE t = c AND h = c) / (count(*) FILTER (WHERE t = c) + count(*) FILTER (WHERE h = c)) AS f1
  FROM h, (VALUES (0), (1)) v(c) GROUP BY 1),
n AS (SELECT sum(t) AS n1, count(*) - sum(t) AS n0, sum(r) FILTER (WHERE t = 1) AS r1 FROM h)""",
"""SELECT (SELECT avg((t = h)::INT) FROM h) AS Accuracy, (SELECT avg(f1) FROM f) AS F1,
 (SELECT (r1 - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1 * n0) FROM n) AS AUROC""", "Accuracy F1 AUROC"))
def _classification(spark, sf):
    return rounded(E.classification_metrics(risks(spark, sf), "y_true", "y_pred"))


# ---- calibration

def _bins_sql(source, lo, hi, bins=10):
    cuts = " + ".join(f"(y_pred >= {lo} + {i} * (({hi} - {lo}) / {bins}.0::DOUBLE))::INT" for i in range(1, bins))
    return f"SELECT {cuts} AS bin, avg(y_pred) AS mean_predicted, avg(y_true) AS mean_observed, count(*) AS n FROM {source} GROUP BY 1"


@add("calibration_bins_reg", report_sql(
    SCORE_SQL + ", e AS (SELECT min(y_pred) AS lo, (max(y_pred) - min(y_pred)) / 10.0::DOUBLE AS step FROM preds)",
    "SELECT " + " + ".join(f"(y_pred >= lo + {i} * step)::INT" for i in range(1, 10)) +
    " AS bin, avg(y_pred) AS mean_predicted, avg(y_true) AS mean_observed, count(*) AS n FROM preds, e GROUP BY 1",
    "mean_predicted mean_observed"))
def _bins(spark, sf):
    return rounded(B.regression_bins(predictions(spark, sf), "y_true", "y_pred"))


@add("reliability_bins", report_sql(SCORE_SQL, _bins_sql("risks", "0.0::DOUBLE", "1.0::DOUBLE"), "mean_predicted mean_observed"))
def _reliability(spark, sf):
    return rounded(B.reliability_bins(risks(spark, sf), "y_true", "y_pred"))


@add("brier_score", report_sql(SCORE_SQL, "SELECT avg((y_pred - y_true) * (y_pred - y_true)) AS brier FROM risks", "brier"))
def _brier(spark, sf):
    return rounded(B.brier_score(risks(spark, sf), "y_true", "y_pred"))


@add("expected_calibration_error", report_sql(
    SCORE_SQL + ", b AS (" + _bins_sql("risks", "0.0::DOUBLE", "1.0::DOUBLE") + ")",
    "SELECT sum(n * abs(mean_predicted - mean_observed)) / sum(n) AS ece FROM b", "ece"))
def _ece(spark, sf):
    return rounded(B.expected_calibration_error(risks(spark, sf), "y_true", "y_pred"))


# ---- resampling and baselines

@add("bootstrap_ci")
def _bootstrap(spark, sf):
    reg = S.intervals(S.bootstrap_regression(predictions(spark, sf), "y_true", "y_pred", reps=500))
    cls = S.intervals(S.bootstrap_classification(risks(spark, sf), "y_true", "y_pred", reps=500))
    return rounded(reg.unionByName(cls))


def binary(spark, sf):
    """The vectors with a 0/1 label."""
    return vectors(spark, sf).withColumn("y", (F.col("y") > 0.3).cast("int"))


@add("permutation_test")
def _permutation(spark, sf):
    scores = S.permutation_scores(vectors(spark, sf), "key", "x", "y", "fold", perms=99, alpha=1.0)
    scored = durable(S.permuted_classifier(binary(spark, sf), "key", "x", "y", "fold", perms=99))
    scores |= S.classifier_scores(scored, 99)
    rows = [(m, float(v[0]), S.permutation_p(v, S.HIGHER_WINS[m])) for m, v in scores.items()]
    return spark.createDataFrame(rows, "metric string, observed double, p double")


def evaluate_linear(df, key, x, y, fold, *, alpha=1.0, reps=500, perms=99, seed=0):
    """metric, point, lo, hi, p of a cross-validated linear model: one prediction pass, one shared permutation pass."""
    preds = M.linear_cv(df, key, x, y, fold, alpha)
    boot = S.intervals(S.bootstrap_regression(preds, "y_true", "y_pred", reps, seed))
    scores = S.permutation_scores(df, key, x, y, fold, perms, seed, alpha)
    ps = df.sparkSession.createDataFrame(
        [(m, S.permutation_p(v, S.HIGHER_WINS[m])) for m, v in scores.items()], "metric string, p double")
    return boot.join(ps, "metric")


def evaluate_classifier(df, key, x, y, fold, *, reps=500, perms=99, seed=0):
    """metric, point, lo, hi, p of AUROC and F1 of a cross-validated ridge classifier tuned per fold, labels 0/1."""
    scored = durable(S.permuted_classifier(df, key, x, y, fold, perms, seed))
    boot = S.intervals(S.bootstrap_classification(scored.where("perm = 0"), "y_true", "y_pred", reps, seed))
    ps = df.sparkSession.createDataFrame(
        [(m, S.permutation_p(v, S.HIGHER_WINS[m])) for m, v in S.classifier_scores(scored, perms).items()], "metric string, p double")
    return boot.join(ps, "metric")


@add("evaluate_model")
def _evaluate(spark, sf):
    linear = evaluate_linear(vectors(spark, sf), "key", "x", "y", "fold")
    return rounded(linear.unionByName(evaluate_classifier(binary(spark, sf), "key", "x", "y", "fold")))


@add("permutation_null_cv5")
def _null(spark, sf):
    df = vectors(spark, sf)
    observed = M.r2(M.loo_closed_form(df, "key", "x", "y")).first()["R2"]
    null = S.permutation_scores(df, "key", "x", "y", "fold", perms=50)["R2"]
    rows = [(i, float(v), float(observed), S.permutation_p(null, observed=observed)) for i, v in enumerate(null[1:])]
    return spark.createDataFrame(rows, "perm int, null_r2 double, observed_loo_r2 double, p double")


def _baseline_rows(spark, sf):
    return S.baseline_scores(vectors(spark, sf), "key", "x", "y")


@add("nested_vs_nonnested")
def _nested(spark, sf):
    got = _baseline_rows(spark, sf)
    a, b = got["nested"]["R2"], got["nonnested"]["R2"]
    return spark.createDataFrame([(a, b, b - a)], "nested_r2 double, nonnested_r2 double, gap double")


@add("baseline_mean", report_sql("", """SELECT 1 - sum(pow(y - (s - y) / (n - 1), 2)) / sum(pow(y - s / n, 2)) AS R2, max(s / n) AS mean, count(*) AS n
 FROM (SELECT l_quantity AS y, sum(l_quantity) OVER () AS s, count(*) OVER () AS n FROM lineitem)""", "R2 mean"))
def _mean(spark, sf):
    return rounded(S.mean_baseline(table(spark, sf, "lineitem"), "l_quantity"))


@add("baseline_shuffled")
def _shuffled(spark, sf):
    got = _baseline_rows(spark, sf)
    return spark.createDataFrame([(got["nested"]["R2"], got["shuffled"]["R2"])], "model_r2 double, shuffled_r2 double")


@add("baseline_random")
def _random(spark, sf):
    got = _baseline_rows(spark, sf)
    return spark.createDataFrame([(got["nested"]["R2"], got["random"]["R2"])], "model_r2 double, random_r2 double")
