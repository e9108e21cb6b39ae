"""Series embeddings, reduction, transforms, selection, fusion, privacy, attribution and scoring."""

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.operators import circadian as W
from meridia.operators import explain as X
from meridia.operators import fusion as U
from meridia.operators import glucose as G
from meridia.operators import highdim as H
from meridia.operators import icc as I
from meridia.operators import models as M
from meridia.operators import privacy as V
from meridia.operators import scoring as C
from meridia.operators import selection as S
from meridia.operators import series as Z
from meridia.operators import transforms as T
from meridia.operators.metrics import regression_metrics
from meridia.operators.ordered import ordered
from meridia.operators.ranking import importance_rank
from meridia.plans.catalog import Catalog, report_sql, rounded
from meridia.plans.glucose_queries import PLACED, placed
from meridia.plans.tables import GRID_SQL, MINUTES_SQL, ORDER_SQL, order_totals, table, vectors
from meridia.plans.wearable_queries import grid, stored_minutes
from meridia.session import durable, scratch_path

catalog = Catalog()
add = catalog.add
NAMES = [f"e{i:02d}" for i in range(64)]


# ---- series

@add("resample_to_length", report_sql(PLACED + """,
sized AS (SELECT * FROM placed WHERE n >= 512),
edges AS (SELECT subject_id, n, t, floor(t * (n / 512.0::DOUBLE)) AS lo, CASE WHEN t = 511 THEN n ELSE floor((t + 1) * (n / 512.0::DOUBLE)) END AS hi
  FROM (SELECT DISTINCT subject_id, n FROM sized), range(512) r(t))""",
"""SELECT e.subject_id, e.t, avg(p.g) AS v FROM edges e JOIN sized p ON p.subject_id = e.subject_id AND p.pos - 1 >= e.lo AND p.pos - 1 < e.hi GROUP BY 1, 2""", "v"))
def _resample(spark, sf):
    return rounded(Z.resample_to_length(placed(spark, sf)))


USER_SERIES = """
u AS (SELECT user_id AS subject_id, value AS g, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
s AS (SELECT DISTINCT subject_id, n, t, t * (n - 1) / 511.0::DOUBLE AS h FROM u, range(512) r(t))"""


def user_rows(spark, sf):
    return table(spark, sf, "events").select("user_id", "value", F.col("ts").cast("string").alias("ts"), "event_id")


def user_trace(spark, sf):
    return G.trace(G.clean_series(user_rows(spark, sf), "user_id", "value", "ts", "event_id"))


@add("resample_to_length_short", report_sql(USER_SERIES, """SELECT s.subject_id, s.t,
  a.g + coalesce((b.g - a.g) * (s.h - floor(s.h)), 0) AS v FROM s JOIN u a ON a.subject_id = s.subject_id AND a.i = floor(s.h)
  LEFT JOIN u b ON b.subject_id = s.subject_id AND b.i = floor(s.h) + 1""", "v", 4))
def _resample_short(spark, sf):
    """Every user's own short trace, stretched to 512 points by interpolation."""
    return rounded(Z.resample_to_length(user_trace(spark, sf)), 4)


@add("series_for_embedding", report_sql(MINUTES_SQL + "," + GRID_SQL, "SELECT subject_id, idx, hr FROM grid WHERE hr IS NOT NULL", "hr"))
def _series(spark, sf):
    g = grid(spark, sf).where("hr is not null")
    return rounded(g.selectExpr("subject_id", "CAST(idx AS BIGINT) AS idx", "hr"))


def glucose_embedding(spark, sf):
    return Z.series_embedding(Z.resample_to_length(user_trace(spark, sf)))


@add("series_embedding")
def _embedding(spark, sf):
    return glucose_embedding(spark, sf)


def benchmark_three(hand, emb, target: str, modality: str):
    """Leave-one-out ridge on hand-made features, on the embedding, and on both, for one target."""
    hand_cols = [c for c in hand.columns if c not in ("subject_id", target)]
    emb_cols = [c for c in emb.columns if c != "subject_id"]
    both = hand.withColumnRenamed(target, "y").join(emb, "subject_id").na.drop(subset=["y", *hand_cols, *emb_cols])
    rows = durable(both.select("subject_id", "y", *[
        F.array(*[F.col(c).cast("double") for c in cols]).alias(name)
        for name, cols in (("handmade", hand_cols), ("embedding", emb_cols), ("both", hand_cols + emb_cols))]), "benchmark")
    parts = [M.ridge_loo(rows, "subject_id", name, "y", alpha=1.0).select(
        F.lit(modality).alias("modality"), F.lit(name).alias("features"), F.lit(target).alias("target"), "y_true", "y_pred")
        for name in ("handmade", "embedding", "both")]
    return reduce(DataFrame.unionByName, parts)


@add("feature_set_benchmark")
def _feature_sets(spark, sf):
    """Both modalities; what would give the target away leaves the predictors."""
    hand = durable(G.glucose_matrix(user_rows(spark, sf), "user_id", "value", "ts", "event_id"))
    glucose = benchmark_three(hand.drop("gmi", "j_index", "conga1", "modd"), glucose_embedding(spark, sf), "mean_glucose", "cgm")
    minutes = stored_minutes(spark, sf)
    hours = W.hour_grid(minutes, ["hr"]).where("hr IS NOT NULL").select("subject_id", "idx", F.col("hr").alias("g"))
    series = ordered(hours, ["subject_id"], ["idx"], pos="pos", totals=True, lead={"g_next": "g"}).withColumnRenamed("pos_total", "n")
    worn = W.wearable_matrix(minutes)
    wearable = benchmark_three(worn, Z.series_embedding(Z.resample_to_length(durable(series, "hours"))), "hr_amplitude", "wearable")
    scored = durable(glucose.unionByName(wearable), "scored")
    return rounded(regression_metrics(scored, "y_true", "y_pred", ["modality", "features", "target"]))


# ---- wide features: vectors with near copies, holes, a sparse and a constant column

def wide_cells(spark, sf):
    e = [F.element_at("embedding", i + 1).cast("double") for i in range(64)]
    cols = {n: v for n, v in zip(NAMES, e)}
    cols.update({f"n{i}": e[i] * 2.0 + e[i + 1] * 0.1 for i in range(6)})
    cols["s0"] = F.when(F.pmod("vec_id", F.lit(10)) < 3, e[0])
    cols["z0"] = F.lit(1.0)
    long = table(spark, sf, "embeddings").select(F.col("vec_id").alias("subject_id"), *[v.alias(n) for n, v in cols.items()]).unpivot(
        ["subject_id"], list(cols), "analyte", "value")
    hole = F.pmod(F.col("subject_id") * 7 + F.length("analyte") + F.ascii(F.substring("analyte", 3, 1)), F.lit(10)) == 0
    return long.withColumn("value", F.when(F.col("analyte").startswith("e") & hole, None).otherwise(F.col("value")))


WIDE_SQL = """
e AS (SELECT vec_id AS subject_id, generate_subscripts(embedding, 1) - 1 AS j, unnest(embedding)::DOUBLE AS v FROM embeddings),
raw AS (SELECT subject_id, 'e' || lpad(j::VARCHAR, 2, '0') AS analyte, v AS value FROM e
 UNION ALL SELECT a.subject_id, 'n' || a.j, a.v * 2.0::DOUBLE + b.v * 0.1::DOUBLE FROM e a JOIN e b ON b.subject_id = a.subject_id AND b.j = a.j + 1 WHERE a.j < 6
 UNION ALL SELECT subject_id, 's0', CASE WHEN subject_id % 10 < 3 THEN v END FROM e WHERE j = 0
 UNION ALL SELECT DISTINCT subject_id, 'z0', 1.0::DOUBLE FROM e),
wide AS (SELECT subject_id, analyte, CASE WHEN analyte LIKE 'e%' AND (subject_id * 7 + length(analyte) + ascii(substr(analyte, 3, 1))) % 10 = 0 THEN NULL ELSE value END AS value FROM raw)"""
DENSE_SQL = WIDE_SQL + """,
med AS (SELECT analyte, quantile_cont(value, 0.5) AS m, var_samp(value) AS vs, avg((value IS NULL)::INT) AS miss FROM wide GROUP BY 1),
dense AS (SELECT w.subject_id, w.analyte, coalesce(w.value, m.m) AS x FROM wide w JOIN med m ON m.analyte = w.analyte WHERE m.vs > 1e-8 AND m.miss <= 0.5),
corrs AS (SELECT a.analyte AS a, b.analyte AS b, abs(corr(a.x, b.x)) AS r FROM dense a JOIN dense b ON b.subject_id = a.subject_id AND b.analyte > a.analyte GROUP BY 1, 2)"""


def filtered(spark, sf):
    return H.variance_filter(H.prevalence_filter(durable(wide_cells(spark, sf))))


@add("prevalence_filter", f"WITH {WIDE_SQL} SELECT analyte, count(*) AS n FROM wide GROUP BY 1 HAVING avg((value IS NULL)::INT) <= 0.5")
def _prevalence(spark, sf):
    return H.prevalence_filter(wide_cells(spark, sf)).groupBy("analyte").agg(F.count("*").alias("n"))


@add("variance_filter", f"WITH {WIDE_SQL} SELECT analyte, count(*) AS n FROM wide GROUP BY 1 HAVING var_samp(value) > 1e-8")
def _variance(spark, sf):
    return H.variance_filter(wide_cells(spark, sf)).groupBy("analyte").agg(F.count("*").alias("n"))


@add("correlation_matrix", report_sql(DENSE_SQL, "SELECT * FROM corrs", "r"))
def _correlation(spark, sf):
    cells = durable(filtered(spark, sf))
    n = cells.agg(F.countDistinct("subject_id")).first()[0]
    stats = durable(H.feature_stats(cells, n), "stats")
    pairs = H.correlation_pairs(H.block_products(cells, stats), H.base_values(stats), n)
    names = stats.select("idx", "analyte")
    return rounded(pairs.join(names.toDF("a", "name_a"), "a").join(names.toDF("b", "name_b"), "b").select(
        F.col("name_a").alias("a"), F.col("name_b").alias("b"), "r"))


@add("correlation_prune", DENSE_SQL.replace("\ne AS", "WITH e AS", 1) + """,
near AS (SELECT a, b FROM corrs WHERE r > 0.95),
heads AS (SELECT a FROM near WHERE a NOT IN (SELECT b FROM near))
SELECT DISTINCT analyte, analyte NOT IN (SELECT b FROM near WHERE a IN (SELECT a FROM heads)) AS kept FROM dense""")
def _prune(spark, sf):
    kept, gone = H.correlation_prune(durable(filtered(spark, sf)))
    return kept.withColumn("kept", F.lit(True)).unionByName(gone.withColumn("kept", F.lit(False)))


@add("pca_embed")
def _pca(spark, sf):
    cells = durable(wide_cells(spark, sf))
    return H.fit_reduction(cells, k=10).apply(cells)


@add("highdim_pipeline")
def _pipeline(spark, sf):
    """Reduced cells and component scores of all subjects, long, with the share of each component."""
    out = H.highdim_pipeline(durable(wide_cells(spark, sf)), k=10)
    cells = out.cells.select(F.lit("cell").alias("part"), "subject_id", F.col("analyte").alias("name"), "value")
    names = [c for c in out.scores.columns if c != "subject_id"]
    scores = out.scores.unpivot(["subject_id"], names, "name", "value").select(F.lit("score").alias("part"), "subject_id", "name", "value")
    shares = spark.createDataFrame(
        [("share", None, n, float(v)) for n, v in zip(names, out.explained)], "part string, subject_id bigint, name string, value double")
    return rounded(cells.unionByName(scores).unionByName(shares))


@add("highdim_matrix")
def _funnel(spark, sf):
    """The count trace of the whole reduction, step by step."""
    return H.fit_reduction(durable(wide_cells(spark, sf)), k=10).trace_frame()


def train_reduction(spark, sf):
    """Learned on two thirds of the subjects."""
    cells = durable(wide_cells(spark, sf))
    return cells, H.fit_reduction(cells.where("subject_id % 3 <> 0"), k=10)


@add("fit_reduction")
def _fit_reduction(spark, sf):
    """The learned state: surviving analytes with median, scale and first loading."""
    return rounded(train_reduction(spark, sf)[1].params.select("analyte", "median", "sd", F.col("loading")[0].alias("loading0")))


@add("apply_reduction")
def _apply_reduction(spark, sf):
    """The state replayed on the remaining third."""
    cells, fitted = train_reduction(spark, sf)
    return fitted.apply(cells.where("subject_id % 3 = 0"))


def wide_labels(spark, sf):
    e = table(spark, sf, "embeddings")
    y = F.element_at("embedding", 1) * 10.0 - F.element_at("embedding", 2) * 6.0 + F.col("label") * 0.1
    return e.select(F.col("vec_id").alias("subject_id"), y.alias("y"), F.pmod("vec_id", F.lit(3)).cast("int").alias("fold"))


@add("highdim_cv")
def _highdim_cv(spark, sf):
    preds, trace = H.highdim_cv(durable(wide_cells(spark, sf)), durable(wide_labels(spark, sf)), "fold", k=20)
    return rounded(regression_metrics(durable(preds), "y_true", "y_pred", ["fold", "model"]).join(trace, "fold"))


@add("optimism_gap")
def _gap(spark, sf):
    return rounded(H.optimism_gap(durable(wide_cells(spark, sf)), durable(wide_labels(spark, sf)), "fold", k=20))


@add("embedding_reduce")
def _reduce(spark, sf):
    """Learned on the even vectors, applied to the odd ones."""
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    fit = Z.fit_vector_reduction(rows.where("vec_id % 2 = 0"), "x", 6)
    return fit.transform(rows.where("vec_id % 2 = 1"), "x", "imaging_f").drop("x")


# ---- transforms

COLS = ["l_quantity", "l_extendedprice", "l_discount"]


def _items(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *COLS)


def _transform_sql(form):
    parts = ", ".join(form.format(c=c) + f" AS {c}" for c in COLS)
    return report_sql("", f"SELECT l_orderkey, l_linenumber, {parts} FROM lineitem", " ".join(COLS))


def _transform(name, sql=None):
    add(f"tf_{name}", sql)(lambda spark, sf: rounded(T.apply_transform(name, _items(spark, sf), COLS)))


_transform("none", _transform_sql("{c}"))
_transform("standard", _transform_sql("({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_pop({c}) FROM lineitem)"))
_transform("robust", _transform_sql("""({c} - (SELECT quantile_cont({c}, 0.5) FROM lineitem)) /
  (SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM lineitem)"""))
_transform("log", _transform_sql("(ln(1 + {c}) - (SELECT avg(ln(1 + {c})) FROM lineitem)) / (SELECT stddev_pop(ln(1 + {c})) FROM lineitem)"))
_transform("power")
_transform("quantile")


# ---- selection

@add("selection_votes")
def _votes(spark, sf):
    """Votes of the four families (filter, wrapper, embedded, explain) in every fold."""
    df = durable(vectors(spark, sf))
    return S.vote_frame(df, S.all_votes(df, NAMES)[1], NAMES)


def _family(name):
    def run(spark, sf):
        df = durable(vectors(spark, sf))
        g = M.fold_grams(df, "x", ["y"], "fold", ("inner",))
        folds = sorted({c[0] for c in g.cells})
        rules = S.ConsensusRules()
        if name == "wrapper":
            picks = S.wrapper_votes(df, "fold", g, NAMES, rules)
        elif name == "embedded":
            picks = {f: S.embedded_votes(g, f, rules) for f in folds}
        else:
            vote = S.filter_votes if name == "filter" else S.explain_votes
            picks = {f: vote(M.train_moments(g, f), rules) for f in folds}
        return S.vote_frame(df, {f: {name: p} for f, p in picks.items()}, NAMES)

    return run


for _name in ("wrapper", "embedded", "explain"):
    add(f"vote_{_name}")(_family(_name))


@add("vote_filter")
def _vote_filter(spark, sf):
    return _family("filter")(spark, sf)


@add("consensus_panel")
def _panel(spark, sf):
    return S.consensus_panel(vectors(spark, sf), "key", NAMES)[0]


@add("stable_panel")
def _stable(spark, sf):
    return S.stable_panel(S.consensus_panel(vectors(spark, sf), "key", NAMES)[1])


# ---- fusion: four blocks of the vector as modalities

BLOCKS = {"omics": (1, 20), "cgm": (21, 8), "wearable": (29, 12), "imaging": (41, 6)}
MODALITIES = list(BLOCKS)


def cohort(spark, sf):
    x = F.transform("embedding", lambda v: v.cast("double"))
    y = x[0] * 6.0 + x[21] * 5.0 + x[29] * 4.0 + x[41] * 3.0
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("key"), y.alias("y"), M.hash_fold("vec_id", 3).alias("fold"),
        *[F.slice(x, a, n).alias(m) for m, (a, n) in BLOCKS.items()])


@add("modality_oof")
def _oof(spark, sf):
    return rounded(U.modality_oof(durable(cohort(spark, sf)), "key", MODALITIES, trees=20))


@add("late_fusion")
def _fusion(spark, sf):
    meta = durable(U.modality_oof(durable(cohort(spark, sf)), "key", MODALITIES, trees=20))
    return rounded(regression_metrics(durable(U.late_fusion(meta, "key", MODALITIES)), "y_true", "y_pred"))


def _list_mean(a, n):
    return f"list_avg(list_transform(list_slice(embedding, {a}, {a + n - 1}), lambda v: v::DOUBLE))"


@add("additive_baseline", report_sql("m AS (SELECT vec_id AS key, embedding[1]::DOUBLE * 6 + embedding[22]::DOUBLE * 5 + embedding[30]::DOUBLE * 4 + embedding[42]::DOUBLE * 3 AS y_true, "
     + ", ".join(f"{_list_mean(a, n)} AS {m}" for m, (a, n) in BLOCKS.items()) + " FROM embeddings)",
     "SELECT key, y_true, " + " + ".join(f"({m} - (SELECT avg({m}) FROM m)) / ((SELECT stddev_pop({m}) FROM m) + 1e-9::DOUBLE)" for m in BLOCKS)
     + " AS y_pred FROM m", "y_true y_pred"))
def _additive(spark, sf):
    return rounded(U.additive_baseline(cohort(spark, sf), "key", MODALITIES))


@add("block_permute")
def _permute(spark, sf):
    mixed = U.block_permute(cohort(spark, sf), "key", MODALITIES)
    return mixed.select("key", "y", *[F.element_at(m, 1).alias(m) for m in MODALITIES])


@add("fusion_controls")
def _controls(spark, sf):
    got, verdict = U.fusion_controls(cohort(spark, sf), "key", MODALITIES, trees=20)
    return rounded(got.select("*", *[F.lit(bool(v)).alias(k) for k, v in verdict.items()]))


@add("modality_ablation")
def _ablation(spark, sf):
    return rounded(U.modality_ablation(cohort(spark, sf), "key", MODALITIES, trees=20))


@add("shared_component_loading")
def _loading(spark, sf):
    c = cohort(spark, sf)
    frames = {m: c.select("key", F.col(m).alias("x")) for m in MODALITIES[:3]}
    return rounded(U.shared_component_loading({**frames, "imaging": None}, "key", {m: 0.5 for m in MODALITIES}))


@add("shared_component_loading_full")
def _loading_full(spark, sf):
    """With a block for every modality, so no loading is a default."""
    c = cohort(spark, sf)
    frames = {m: c.select("key", F.col(m).alias("x")) for m in MODALITIES}
    return rounded(U.shared_component_loading(frames, "key", {m: 0.5 for m in MODALITIES}))


RATERS = ["click", "error", "purchase", "signup", "view"]


def ratings(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("user_id").pivot("event_type", RATERS).agg(F.avg("value")).na.drop()


ICC_SQL = """
c AS (SELECT user_id, event_type, avg(value) AS x FROM events GROUP BY 1, 2),
full_ AS (SELECT * FROM c WHERE user_id IN (SELECT user_id FROM c GROUP BY 1 HAVING count(*) = 5)),
g AS (SELECT avg(x) AS m, count(DISTINCT user_id) AS n, 5 AS k FROM full_),
ss AS (SELECT (SELECT sum(pow(x - m, 2)) FROM full_, g) AS t, (SELECT 5 * sum(pow(r - m, 2)) FROM (SELECT avg(x) AS r FROM full_ GROUP BY user_id), g) AS r,
  (SELECT n * q FROM (SELECT sum(pow(r - m, 2)) AS q FROM (SELECT avg(x) AS r FROM full_ GROUP BY event_type), g), g) AS c),
ms AS (SELECT n, k, r / (n - 1) AS ms_rows, c / (k - 1) AS ms_cols, (t - r - c) / ((n - 1) * (k - 1)) AS ms_error FROM ss, g)"""


@add("icc", report_sql(ICC_SQL, """SELECT 'ICC(2,1)' AS icc_type, (ms_rows - ms_error) / (ms_rows + (k - 1) * ms_error + k / n::DOUBLE * (ms_cols - ms_error)) AS icc,
  n AS n_subjects, k::BIGINT AS k_raters, ms_rows / ms_error AS f_value, ms_rows, ms_cols, ms_error FROM ms
 UNION ALL SELECT 'ICC(2,k)', (ms_rows - ms_error) / (ms_rows + (ms_cols - ms_error) / n), n, k, ms_rows / ms_error, ms_rows, ms_cols, ms_error FROM ms""",
 "icc f_value ms_rows ms_cols ms_error"))
def _icc(spark, sf):
    r = durable(ratings(spark, sf))
    both = I.icc(r, RATERS).unionByName(I.icc(r, RATERS, "ICC(2,k)"))
    return rounded(both.drop("ci_lo", "ci_hi", "confidence"))


@add("icc_interval")
def _icc_interval(spark, sf):
    r = durable(ratings(spark, sf))
    return I.icc(r, RATERS).unionByName(I.icc(r, RATERS, "ICC(2,k)"))


# ---- privacy

@add("dp_mean")
def _dp_mean(spark, sf):
    return rounded(V.dp_mean(table(spark, sf, "events"), "value", 1.0, 1e-5, 0.0, 200.0, keys=["event_type"]))


@add("dp_mean_exact", report_sql("", "SELECT event_type, count(*) AS n, avg(least(greatest(value, 0), 200)) AS dp_mean, 0.0::DOUBLE AS sigma FROM events GROUP BY 1", "dp_mean sigma"))
def _dp_exact(spark, sf):
    return rounded(V.dp_mean(table(spark, sf, "events"), "value", math.inf, 1e-5, 0.0, 200.0, keys=["event_type"]))


def item_features(spark, sf):
    return table(spark, sf, "lineitem").select(*COLS).unpivot([], COLS, "feature", "value")


@add("dp_summary")
def _dp_summary(spark, sf):
    return rounded(V.dp_summary(item_features(spark, sf), 1.0, 1e-5))


def binary_vectors(spark, sf):
    v = vectors(spark, sf)
    return v.select("key", "x", (F.col("y") > 0.3).cast("int").alias("y"), F.pmod("key", F.lit(4)).alias("site"))


@add("dp_logistic")
def _dp_logistic(spark, sf):
    w, exact, sigma = V.dp_logistic(binary_vectors(spark, sf), "x", "y", 1.0, 1e-5, lam=0.1)
    return spark.createDataFrame([(n, float(a), float(b), float(sigma)) for n, a, b in zip(NAMES, w, exact)],
                                 "feature string, coef double, exact_coef double, sigma double")


@add("privacy_sweep")
def _sweep(spark, sf):
    rows = durable(binary_vectors(spark, sf))
    return V.privacy_sweep(rows, "x", "y", item_features(spark, sf), [0.5, 1.0, 4.0, math.inf], 10, lam=0.1)


@add("weighted_param_average", report_sql("s AS (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS a, avg(l_tax) AS b FROM lineitem GROUP BY 1)",
     "SELECT 0 AS pos, sum(n * a) / sum(n) AS value FROM s UNION ALL SELECT 1, sum(n * b) / sum(n) FROM s", "value"))
def _average(spark, sf):
    sites = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.array(F.avg("l_quantity"), F.avg("l_tax")).alias("params"))
    return rounded(V.weighted_param_average(sites))


@add("site_partitioned_fit")
def _sites(spark, sf):
    return rounded(V.site_partitioned_fit(binary_vectors(spark, sf), "key", "site", "x", "y"))


# ---- attribution

def boosted(spark, sf):
    df = durable(vectors(spark, sf))
    return df, X.fit_boosted(df, "x", "y", maxIter=10)


@add("tree_attribution")
def _attribution(spark, sf):
    df, model = boosted(spark, sf)
    rows = durable(X.tree_attribution(model, df, "key", "x"))
    return rounded(importance_rank(X.attribution_ranking(rows, NAMES), "analyte", "mean_abs"))


@add("gain_importance")
def _gain(spark, sf):
    _, model = boosted(spark, sf)
    return rounded(importance_rank(X.gain_importance(model, NAMES, spark), "analyte", "gain"))


@add("ale_1d")
def _ale(spark, sf):
    df, model = boosted(spark, sf)
    names = F.array(*[F.lit(n) for n in NAMES])
    curves = X.ale_curves(model, df, "x", list(range(len(NAMES))))
    return rounded(curves.select("edge", "effect", "n", F.element_at(names, F.col("feature") + 1).alias("feature")))


# ---- scoring

@add("fit_scoring_model")
def _fit(spark, sf):
    """Trained, stored as a coefficient table and read back."""
    df = vectors(spark, sf).select("key", "y", *[F.col("x")[i].alias(n) for i, n in enumerate(NAMES)])
    path = scratch_path(spark, "model")
    C.fit_scoring_model(durable(df), NAMES, "y").save(spark, path)
    return rounded(spark.read.parquet(path))


@add("score_batch", report_sql(ORDER_SQL + ", f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM t)",
     "SELECT key, 'ols' AS model, a + b * x AS prediction, 1 AS n_features FROM t, f", "prediction", 4))
def _score(spark, sf):
    rows = order_totals(spark, sf).select("key", "y", F.col("x")[0].alias("quantity"))
    model = C.fit_scoring_model(rows, ["quantity"], "y", "ols", alpha=0.0)
    return rounded(model.score(rows.select("key", "quantity"), ["key"]), 4)


@add("score_profile")
def _profile(spark, sf):
    c = durable(cohort(spark, sf))
    predictor = C.build_predictor(c, "key", MODALITIES, trees=20)
    # five kinds of events feed four modalities: signups and views together are the last one
    kind = F.when(F.col("event_type").isin("signup", "view"), "visit").otherwise(F.col("event_type"))
    events = table(spark, sf, "events").withColumn("kind", kind)
    signal = events.groupBy("user_id").pivot("kind", ["click", "error", "purchase", "visit"]).agg(F.avg((F.col("value") - 50) / 50))
    signals = signal.na.fill(0.0).toDF("user_id", *MODALITIES)
    return rounded(predictor.score(signals, "user_id"))


@add("holdout_residuals", report_sql(ORDER_SQL + """,
fits AS (SELECT f, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM t JOIN (SELECT DISTINCT fold AS f FROM t) ON fold <> f GROUP BY 1)""",
"SELECT key, y AS measured, a + b * x AS predicted, abs(y - a - b * x) AS abs_error FROM t JOIN fits ON f = fold", "measured predicted abs_error", 4))
def _residuals(spark, sf):
    return rounded(C.holdout_residuals(M.linear_cv(order_totals(spark, sf), "key", "x", "y"), "key"), 4)
