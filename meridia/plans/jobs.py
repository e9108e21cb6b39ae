"""Batch jobs: compositions of the operators, each returning its report."""

from pyspark.sql import functions as F

from meridia.operators import calibration as B
from meridia.operators import clean as K
from meridia.operators import explain as X
from meridia.operators import models as M
from meridia.operators import privacy as V
from meridia.operators import relational as J
from meridia.operators import resampling as S
from meridia.operators import selection as L
from meridia.operators.metrics import regression_metrics
from meridia.operators.ranking import importance_rank
from meridia.operators.reshape import pivot_topk, union_reports
from meridia.plans.advanced_queries import NAMES, binary_vectors, boosted, item_features
from meridia.plans.catalog import Catalog, rounded
from meridia.plans.model_queries import evaluate_linear
from meridia.plans.source_queries import store
from meridia.plans.tables import cells, crosswalk, risks, subjects, table, vectors
from meridia.session import durable

catalog = Catalog()
add = catalog.add


@add("job_warehouse", """WITH f AS (SELECT count(DISTINCT l_suppkey) AS n FROM lineitem)
SELECT 'raw' AS layer, 'subjects' AS name, count(*) AS n FROM customer UNION ALL SELECT 'staging', 'subjects', count(*) FROM customer
UNION ALL SELECT 'analytics', 'feature_matrix', n FROM f UNION ALL SELECT 'analytics', 'patient_multimodal', count(*) FROM customer
UNION ALL SELECT 'quality', 'null_sspg', count(*) FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'quality', 'negative_values', 0
UNION ALL SELECT 'quality', 'orphan_crosswalk', count(*) FROM orders WHERE o_orderkey % 50 = 0""")
def _warehouse(spark, sf):
    """Raw -> staging -> analytics tables, then the quality row, as one table of counts."""
    s = store(spark)
    s.create_all()
    raw = subjects(spark, sf)
    s.append("subjects", raw)
    long = durable(cells(spark, sf), "cells")
    K.staging_distinct(raw, "subject_id", ["iris"], ["sspg"]).write.saveAsTable(s.name("staging_subjects"))
    pivot_topk(long).write.saveAsTable(s.name("feature_matrix"))
    g = F.col("value")
    cgm = table(spark, sf, "events").groupBy(F.col("user_id").alias("subject_id")).agg(F.avg(g).alias("mean_glucose"))
    J.patient_multimodal(raw, J.panel_agg(long), cgm).write.saveAsTable(s.name("patient_multimodal"))
    dq = K.dq_assertions(raw, long, crosswalk(spark, sf))
    out = dq.unpivot([], dq.columns, "name", "n").select(F.lit("quality").alias("layer"), "name", F.col("n").cast("bigint").alias("n"))
    for layer, name, stored in (("raw", "subjects", "subjects"), ("staging", "subjects", "staging_subjects"),
                                ("analytics", "feature_matrix", "feature_matrix"), ("analytics", "patient_multimodal", "patient_multimodal")):
        out = out.unionByName(s.table(stored).agg(F.lit(layer).alias("layer"), F.lit(name).alias("name"), F.count("*").alias("n")))
    return out


@add("job_baseline_models")
def _baselines(spark, sf):
    """Linear and boosted-tree scores on the same folds."""
    df = durable(vectors(spark, sf))
    out = None
    for name, preds in (("ridge", M.ridge_path_cv(df, "key", "x", "y")[0]), ("boosted", M.tree_cv(df, "key", "x", "y", kind="boosted", maxIter=5))):
        part = regression_metrics(durable(preds), "y_true", "y_pred").withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return rounded(out)


@add("job_rigor_checks")
def _rigor(spark, sf):
    """Six checks: nested, non-nested, their gap, and the three trivial baselines."""
    df = durable(vectors(spark, sf))
    got = {k: v["R2"] for k, v in S.baseline_scores(df, "key", "x", "y").items()}
    mean = S.mean_baseline(df, "y").first()["R2"]
    rows = [("nested", got["nested"]), ("nonnested", got["nonnested"]), ("gap", got["nonnested"] - got["nested"]),
            ("mean", mean), ("shuffled", got["shuffled"]), ("random", got["random"])]
    return spark.createDataFrame([(a, float(b)) for a, b in rows], "check string, r2 double")


@add("job_stats_report")
def _stats(spark, sf):
    """Metric rows with interval and p-value, plus the calibration of a probability."""
    r = durable(risks(spark, sf))
    calibration = B.brier_score(r, "y_true", "y_pred").select(F.lit("brier").alias("metric"), F.col("brier").alias("point")).unionByName(
        B.expected_calibration_error(r, "y_true", "y_pred").select(F.lit("ece").alias("metric"), F.col("ece").alias("point")))
    return rounded(union_reports({
        "regression": evaluate_linear(durable(vectors(spark, sf)), "key", "x", "y", "fold", reps=300, perms=49),
        "classification": S.intervals(S.bootstrap_classification(r, "y_true", "y_pred", reps=300)), "calibration": calibration}))


@add("job_attribution")
def _attribution(spark, sf):
    """Top features by attribution next to split gain and consensus selection frequency."""
    df, model = boosted(spark, sf)
    shap = importance_rank(X.attribution_ranking(durable(X.tree_attribution(model, df, "key", "x")), NAMES), "analyte", "mean_abs", "rank_main")
    gain = importance_rank(X.gain_importance(model, NAMES, spark), "analyte", "gain", "rank_gain")
    freq = L.consensus_panel(df, "key", NAMES)[1].where("in_frozen_set > 0").select(
        F.col("feature").alias("analyte"), F.col("frequency").alias("consensus_freq"))
    return rounded(J.ranking_join(shap, gain, freq))


@add("job_privacy")
def _privacy(spark, sf):
    """Sectioned table: noise sweep and site-wise against central fitting."""
    rows = durable(binary_vectors(spark, sf))
    return rounded(union_reports({
        "sweep": V.privacy_sweep(rows, "x", "y", item_features(spark, sf), [0.5, 1.0, float("inf")], 5, lam=0.1),
        "sites": V.site_partitioned_fit(rows, "key", "site", "x", "y", rounds=3)}))
