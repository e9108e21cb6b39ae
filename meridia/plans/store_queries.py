"""Reshape, join, aggregate and ranking queries over the subject store."""

from pyspark.sql import functions as F

from meridia.functions.columns import exact_mean, exact_sum
from meridia.operators import clean as K
from meridia.operators import ranking as R
from meridia.operators import relational as J
from meridia.operators import reshape as P
from meridia.plans.catalog import Catalog, report_sql, rounded
from meridia.plans.tables import STORE_SQL, TRACE_SQL, TRAITS_SQL, cells, crosswalk, subjects, table, trace_rows, traits
from meridia.operators.glucose import clean_series
from meridia.session import scratch_path

catalog = Catalog()
add = catalog.add
TRAITS = ["quantity", "TGL", "HDL", "tax"]
ANALYTES = [f"a{i}" for i in range(20)]
MELTED = TRAITS_SQL + ", melted AS (" + " UNION ALL ".join(
    f"SELECT subject_id, '{c}' AS feature, {c} AS value FROM traits" for c in TRAITS) + ")"


def melted(spark, sf):
    return P.melt(traits(spark, sf), "subject_id", TRAITS)


@add("melt_long", report_sql(MELTED, "SELECT * FROM melted WHERE value IS NOT NULL", "value"))
def _melt(spark, sf):
    return rounded(melted(spark, sf))


@add("append_feature_matrix", report_sql(MELTED, "SELECT * FROM melted WHERE value IS NOT NULL", "value"))
def _append(spark, sf):
    """Two features first, then all of them: the second append adds only the missing keys."""
    path = scratch_path(spark, "features")
    rows = melted(spark, sf)
    rows.where(F.col("feature").isin("quantity", "tax")).write.parquet(path)
    stored = spark.read.parquet(path)
    P.insert_missing(stored, rows, ["subject_id", "feature"]).write.mode("append").parquet(path)
    return rounded(spark.read.parquet(path))


PANELS = TRAITS_SQL + """,
p1 AS (SELECT s.c_custkey AS subject_id, s.c_mktsegment AS iris, t.quantity, t.tax FROM customer s JOIN traits t ON t.subject_id = s.c_custkey WHERE s.c_nationkey < 15),
p2 AS (SELECT s.c_custkey AS subject_id, s.c_acctbal AS sspg, t.TGL, t.HDL FROM customer s JOIN traits t ON t.subject_id = s.c_custkey WHERE s.c_nationkey >= 10)"""


def panel_frames(spark, sf):
    both = traits(spark, sf).join(
        table(spark, sf, "customer").select(F.col("c_custkey").alias("subject_id"), "c_mktsegment", "c_acctbal", "c_nationkey"), "subject_id")
    one = both.where("c_nationkey < 15").select("subject_id", F.col("c_mktsegment").alias("iris"), "quantity", "tax")
    two = both.where("c_nationkey >= 10").select("subject_id", F.col("c_acctbal").alias("sspg"), "TGL", "HDL")
    return {"S9": (one, ["quantity", "tax"]), "S8": (two, ["TGL", "HDL"])}


@add("ingest_panels", report_sql(PANELS, """SELECT c.subject_id, s.sspg, s.iris, c.panel, c.analyte, c.value FROM (
  SELECT subject_id, 'S9' AS panel, 'quantity' AS analyte, quantity AS value FROM p1 UNION ALL SELECT subject_id, 'S9', 'tax', tax FROM p1
  UNION ALL SELECT subject_id, 'S8', 'TGL', TGL FROM p2 UNION ALL SELECT subject_id, 'S8', 'HDL', HDL FROM p2) c
 JOIN (SELECT coalesce(p1.subject_id, p2.subject_id) AS subject_id, sspg, iris FROM p1 FULL JOIN p2 ON p1.subject_id = p2.subject_id) s
  ON s.subject_id = c.subject_id""", "sspg value"))
def _ingest(spark, sf):
    subs, long = P.ingest_panels(panel_frames(spark, sf))
    return rounded(long.join(subs, "subject_id").select("subject_id", "sspg", "iris", "panel", "analyte", "value"))


@add("ingest_crosswalk", f"WITH {STORE_SQL} SELECT omics_subject_id::VARCHAR AS omics_subject_id, cgm_subject_id, site_code, wearable_subject_id FROM crosswalk")
def _crosswalk(spark, sf):
    holes = crosswalk(spark, sf).withColumn("cgm_subject_id", F.coalesce("cgm_subject_id", F.lit("nan")))
    return P.crosswalk_rows(holes)


@add("matrix_by_panel", report_sql(STORE_SQL, "SELECT c.subject_id, s.sspg, " + ", ".join(
    f"max(value) FILTER (WHERE analyte = '{a}') AS {a}" for a in ANALYTES) + """ FROM cells c JOIN subjects s ON s.subject_id = c.subject_id
  WHERE panel = 'R' GROUP BY 1, 2""", "sspg " + " ".join(ANALYTES)))
def _matrix(spark, sf):
    return rounded(P.panel_matrix(cells(spark, sf), subjects(spark, sf), "R", "sspg", ANALYTES))


@add("feature_wide", report_sql(MELTED, "SELECT subject_id, quantity, TGL, HDL, tax FROM traits WHERE subject_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')", "quantity TGL HDL tax"))
def _wide(spark, sf):
    return rounded(P.feature_wide(melted(spark, sf), TRAITS, subjects(spark, sf).where("iris = 'BUILDING'")))


TOPK = """SELECT l_shipmonth AS analyte, count(DISTINCT l_suppkey) AS n_subjects FROM shipped GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8"""
SHIPPED = "shipped AS (SELECT l_suppkey, 'm' || strftime(l_shipdate, '%Y%m') AS l_shipmonth, l_quantity FROM lineitem)"


def shipped(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("subject_id"), F.concat(F.lit("m"), F.date_format("l_shipdate", "yyyyMM")).alias("analyte"),
        F.col("l_quantity").alias("value"))


@add("topk_by_distinct", f"WITH {SHIPPED} {TOPK}")
def _topk(spark, sf):
    return P.topk_by_distinct(shipped(spark, sf))


@add("pivot_topk", report_sql(STORE_SQL + """,
best AS (SELECT analyte FROM cells GROUP BY 1 ORDER BY count(DISTINCT subject_id) DESC, analyte LIMIT 8),
ranked AS (SELECT analyte, row_number() OVER (ORDER BY analyte) AS i FROM best)""",
"SELECT c.subject_id, " + ", ".join(
    f"avg(c.value) FILTER (WHERE c.analyte = '{a}') AS {a}" for a in ["a0", "a1", "a10", "a11", "a12", "a13", "a14", "a15"]) +
" FROM cells c GROUP BY 1", "a0 a1 a10 a11 a12 a13 a14 a15"))
def _pivot(spark, sf):
    """Every analyte covers every subject here, so the tie-break by name decides the eight columns."""
    return rounded(P.pivot_topk(cells(spark, sf)))


@add("conditional_pivot", report_sql(MELTED, """SELECT subject_id, max(CASE WHEN feature = 'TGL' THEN value END) AS mean_price,
  max(CASE WHEN feature = 'tax' THEN value END) AS mean_tax FROM melted GROUP BY 1""", "mean_price mean_tax"))
def _cond(spark, sf):
    return rounded(P.conditional_pivot(melted(spark, sf), {"TGL": "mean_price", "tax": "mean_tax"}))


def wide_sheet(spark, sf):
    """Part types (repeated analyte names) x patient headers NN-NNN/Zcode, plus summary columns."""
    parts = table(spark, sf, "part")
    heads = [f"{10 + i}-{i:03d}/Z{i:05d}" for i in range(12)]
    values = [F.when(F.pmod("p_partkey", F.lit(12)) != i, F.col("p_retailprice") + i).cast("string").alias(h) for i, h in enumerate(heads)]
    return parts.select(F.col("p_name").alias("name"), "p_partkey", *values, F.col("p_size").alias("All"), F.col("p_type").alias("Type"))


@add("orient_transpose", report_sql("""firsts AS (SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY 1)""",
"""SELECT (10 + i) || '-' || lpad(i::VARCHAR, 3, '0') AS site_code, 'Z' || lpad(i::VARCHAR, 5, '0') AS zcode, p.p_name AS analyte,
  CASE WHEN p.p_partkey % 12 <> i THEN p.p_retailprice + i END AS value
 FROM part p JOIN firsts f ON f.p_partkey = p.p_partkey, range(12) r(i)""", "value"))
def _orient(spark, sf):
    return rounded(P.orient(wide_sheet(spark, sf), "name", "p_partkey"))


@add("concat_feature_blocks", report_sql(TRAITS_SQL, """SELECT t.subject_id, t.quantity, t.tax, u.TGL, b.s_acctbal FROM traits t
  JOIN traits u ON u.subject_id = t.subject_id JOIN supplier b ON b.s_suppkey = t.subject_id""", "quantity tax TGL s_acctbal"))
def _blocks(spark, sf):
    t = traits(spark, sf)
    sup = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("subject_id"), "s_acctbal")
    return rounded(P.concat_blocks([t.select("subject_id", "quantity", "tax"), t.select("subject_id", "TGL"), sup]))


@add("union_reports", report_sql(STORE_SQL, """SELECT 'subjects' AS section, iris AS class, count(*) AS n, avg(sspg) AS sspg, NULL::DOUBLE AS value FROM subjects GROUP BY 2
 UNION ALL SELECT 'cells', panel, count(*), NULL, avg(value) FROM cells GROUP BY 2""", "sspg value"))
def _reports(spark, sf):
    a = subjects(spark, sf).groupBy(F.col("iris").alias("class")).agg(F.count("*").alias("n"), F.avg("sspg").alias("sspg"))
    b = cells(spark, sf).groupBy(F.col("panel").alias("class")).agg(F.count("*").alias("n"), F.avg("value").alias("value"))
    return rounded(P.union_reports({"subjects": a, "cells": b}))


# ---- joins

@add("overlap_cohort", f"""WITH {STORE_SQL} SELECT omics_subject_id, cgm_subject_id, site_code, iris, sspg FROM crosswalk c
  JOIN subjects s ON s.subject_id = c.omics_subject_id WHERE cgm_subject_id IS NOT NULL""")
def _overlap(spark, sf):
    return J.overlap_cohort(crosswalk(spark, sf), subjects(spark, sf))


CGM_AGG = "SELECT user_id AS subject_id, avg(value) AS mean_glucose, avg((value >= 70 AND value <= 180)::INT) AS tir FROM events GROUP BY 1"


@add("patient_multimodal", report_sql(STORE_SQL, f"""SELECT s.subject_id, s.iris, s.sspg, o.n_analytes, o.mean_value, c.mean_glucose, c.tir,
  c.subject_id IS NOT NULL AS has_cgm FROM subjects s
  LEFT JOIN (SELECT subject_id, count(DISTINCT analyte) AS n_analytes, avg(value) AS mean_value FROM cells GROUP BY 1) o ON o.subject_id = s.subject_id
  LEFT JOIN ({CGM_AGG}) c ON c.subject_id = s.subject_id""", "mean_value mean_glucose tir"))
def _multimodal(spark, sf):
    g = F.col("value")
    cgm = table(spark, sf, "events").groupBy(F.col("user_id").alias("subject_id")).agg(
        F.avg(g).alias("mean_glucose"), F.avg(((g >= 70) & (g <= 180)).cast("int")).alias("tir"))
    return rounded(J.patient_multimodal(
        subjects(spark, sf).select("subject_id", "iris", "sspg"), J.panel_agg(cells(spark, sf)), cgm))


@add("orphan_rows", f"""WITH {STORE_SQL} SELECT omics_subject_id, site_code FROM crosswalk c
  WHERE NOT EXISTS (SELECT 1 FROM subjects s WHERE s.subject_id = c.omics_subject_id)""")
def _orphans(spark, sf):
    return K.orphan_rows(crosswalk(spark, sf), subjects(spark, sf)).select("omics_subject_id", "site_code")


@add("subject_feature_counts", f"""WITH {STORE_SQL} SELECT s.subject_id, s.sspg, count(c.analyte) AS n_features FROM subjects s
  LEFT JOIN cells c ON c.subject_id = s.subject_id WHERE s.sspg IS NOT NULL GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 5""")
def _counts(spark, sf):
    return J.subject_feature_counts(subjects(spark, sf), cells(spark, sf))


@add("label_fill_join", report_sql(STORE_SQL + "," + TRAITS_SQL, """SELECT t.subject_id, t.quantity, coalesce(a.sspg, b.s_acctbal) AS label,
  CASE WHEN a.sspg IS NOT NULL THEN 'first' ELSE 'second' END AS origin
 FROM traits t LEFT JOIN subjects a ON a.subject_id = t.subject_id LEFT JOIN supplier b ON b.s_suppkey = t.subject_id
 WHERE coalesce(a.sspg, b.s_acctbal) IS NOT NULL""", "quantity label"))
def _fill(spark, sf):
    first = subjects(spark, sf).select("subject_id", F.col("sspg").alias("label"))
    second = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("subject_id"), F.col("s_acctbal").alias("label"))
    return rounded(J.label_fill_join(traits(spark, sf).select("subject_id", "quantity"), first, second))


@add("site_code_link", f"""WITH {STORE_SQL} SELECT '1636-' || l.l_orderkey AS subject_id, l.l_orderkey::VARCHAR AS site_code, c.omics_subject_id, s.sspg AS label
 FROM (SELECT DISTINCT l_orderkey FROM lineitem) l JOIN crosswalk c ON c.site_code = l.l_orderkey::VARCHAR
 JOIN subjects s ON s.subject_id = c.omics_subject_id WHERE s.sspg IS NOT NULL""")
def _site(spark, sf):
    series = table(spark, sf, "lineitem").select(F.concat(F.lit("1636-"), F.col("l_orderkey").cast("string")).alias("subject_id"))
    labels = subjects(spark, sf).select(F.col("subject_id").alias("omics_subject_id"), F.col("sspg").alias("label"))
    return J.site_code_link(series, crosswalk(spark, sf).select("site_code", "omics_subject_id"), labels)


@add("key_intersection", "SELECT DISTINCT c_custkey AS subject_id FROM customer WHERE c_custkey IN (SELECT user_id FROM events)")
def _common(spark, sf):
    return J.key_intersection(subjects(spark, sf), table(spark, sf, "events").select(F.col("user_id").alias("subject_id")))


# ---- importance tables: part keys as features

IMPORTANCE = """
main AS (SELECT l_partkey AS analyte, sum(l_extendedprice * l_discount) AS v FROM lineitem GROUP BY 1),
gain AS (SELECT l_partkey AS analyte, sum(l_quantity) AS v FROM lineitem GROUP BY 1),
cons AS (SELECT l_partkey AS analyte, avg(l_discount) AS v FROM lineitem GROUP BY 1)"""


def importance(spark, sf, v):
    """Sums that no order of the rows changes: parts with the same line items tie, and ties rank by part."""
    return table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("analyte")).agg(v.alias("v"))


def main_importance(spark, sf):
    return importance(spark, sf, exact_sum(F.col("l_extendedprice") * F.col("l_discount")))


def gain_importance(spark, sf):
    return importance(spark, sf, exact_sum("l_quantity"))


def consensus_freq(spark, sf):
    return importance(spark, sf, exact_mean("l_discount"))


@add("ranking_join", report_sql(IMPORTANCE, """SELECT m.analyte, m.v AS main, m.rank_main, g.v AS gain, g.rank_gain, c.v AS consensus_freq
 FROM (SELECT *, row_number() OVER (ORDER BY v DESC, analyte) AS rank_main FROM main) m
 LEFT JOIN (SELECT *, row_number() OVER (ORDER BY v DESC, analyte) AS rank_gain FROM gain) g ON g.analyte = m.analyte
 LEFT JOIN cons c ON c.analyte = m.analyte ORDER BY rank_main LIMIT 20""", "main gain consensus_freq", 4))
def _rankings(spark, sf):
    m = R.importance_rank(main_importance(spark, sf), "analyte", "v", "rank_main").withColumnRenamed("v", "main")
    g = R.importance_rank(gain_importance(spark, sf), "analyte", "v", "rank_gain").withColumnRenamed("v", "gain")
    c = consensus_freq(spark, sf).withColumnRenamed("v", "consensus_freq")
    return rounded(J.ranking_join(m, g, c), 4)


@add("importance_rank", report_sql(IMPORTANCE, "SELECT analyte, v, row_number() OVER (ORDER BY v DESC, analyte) AS rank FROM main", "v", 4))
def _rank(spark, sf):
    return rounded(R.importance_rank(main_importance(spark, sf), "analyte", "v"), 4)


@add("cumulative_concentration", report_sql(IMPORTANCE + """,
c AS (SELECT analyte, sum(v) OVER (ORDER BY v DESC, analyte ROWS UNBOUNDED PRECEDING) / sum(v) OVER () AS cum FROM main)""",
"SELECT t AS threshold, 1 + (SELECT count(*) FROM c WHERE cum < t) AS n_features, (SELECT count(*) FROM c) AS n_total FROM (VALUES (0.8::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE)) x(t)"))
def _concentration(spark, sf):
    return R.concentration(main_importance(spark, sf), "analyte", "v")


@add("near_zero_count", f"WITH {IMPORTANCE} SELECT count(*) FILTER (WHERE v < 0.5 * (SELECT max(v) FROM main)) AS n_near_zero, count(*) AS n FROM main")
def _near_zero(spark, sf):
    """Half the maximum here: no part is below the operator's default of one millionth."""
    return R.near_zero(main_importance(spark, sf), "v", 0.5)


@add("topk_agreement", f"""WITH {IMPORTANCE}, a AS (SELECT analyte FROM main ORDER BY v DESC, analyte LIMIT 50), b AS (SELECT analyte FROM gain ORDER BY v DESC, analyte LIMIT 50),
 c AS (SELECT analyte FROM cons ORDER BY v DESC, analyte LIMIT 50)
 SELECT 'main&gain' AS sets, count(*) AS overlap FROM a JOIN b USING (analyte) UNION ALL SELECT 'main&consensus', count(*) FROM a JOIN c USING (analyte)
 UNION ALL SELECT 'gain&consensus', count(*) FROM b JOIN c USING (analyte)
 UNION ALL SELECT 'main&gain&consensus', count(*) FROM a JOIN b USING (analyte) JOIN c USING (analyte)""")
def _agreement(spark, sf):
    return R.topk_agreement(
        {"main": main_importance(spark, sf), "gain": gain_importance(spark, sf), "consensus": consensus_freq(spark, sf)}, "analyte", "v", 50)


# ---- aggregates, windows, sets

@add("subject_count", "SELECT count(*) AS n FROM customer")
def _count(spark, sf):
    return subjects(spark, sf).agg(F.count("*").alias("n"))


@add("panel_agg", report_sql(STORE_SQL, "SELECT subject_id, count(DISTINCT analyte) AS n_analytes, avg(value) AS mean_value FROM cells GROUP BY 1", "mean_value"))
def _panel(spark, sf):
    return rounded(J.panel_agg(cells(spark, sf)))


@add("class_distribution", report_sql("", "SELECT event_type, count(*) AS n, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS pct FROM events GROUP BY 1", "pct"))
def _classes(spark, sf):
    return rounded(J.class_distribution(table(spark, sf, "events"), "event_type"))


@add("class_weights", report_sql("""n AS (SELECT r.i AS label, count(e.label) AS n FROM range(12) r(i) LEFT JOIN embeddings e ON e.label = r.i GROUP BY 1)""",
"SELECT label, n, coalesce(1.0::DOUBLE / nullif(n, 0), 0) / (SELECT sum(1.0::DOUBLE / n) FROM n WHERE n > 0) * 12 AS weight FROM n", "weight"))
def _weights(spark, sf):
    return rounded(J.class_weights(table(spark, sf, "embeddings"), "label", 12))


@add("param_summary", report_sql("", """SELECT 'l_quantity' AS "column", median(l_quantity) AS median, min(l_quantity) AS min, max(l_quantity) AS max, NULL::VARCHAR AS value, NULL::BIGINT AS n FROM lineitem
 UNION ALL SELECT 'l_extendedprice', median(l_extendedprice), min(l_extendedprice), max(l_extendedprice), NULL, NULL FROM lineitem
 UNION ALL SELECT 'l_tax', NULL, NULL, NULL, l_tax::VARCHAR, count(*) FROM lineitem GROUP BY l_tax
 UNION ALL SELECT 'l_returnflag', NULL, NULL, NULL, l_returnflag, count(*) FROM lineitem GROUP BY l_returnflag""", "median min max"))
def _params(spark, sf):
    return rounded(J.param_summary(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax", "l_returnflag"]))


@add("tertile_tiers", """WITH q AS (SELECT quantile_cont(c_acctbal, 1.0::DOUBLE / 3) AS a, quantile_cont(c_acctbal, 2.0::DOUBLE / 3) AS b FROM customer)
 SELECT c_custkey, c_acctbal, CASE WHEN c_acctbal < a THEN 'Low' WHEN c_acctbal < b THEN 'Moderate' ELSE 'High' END AS tier FROM customer, q""")
def _tiers(spark, sf):
    return J.risk_tiers(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal")


@add("signed_risk_signal", report_sql("""
s AS (SELECT user_id AS subject_id, event_type, (CASE WHEN event_type IN ('signup', 'view') THEN -1 ELSE 1 END) * (value - 60) / (greatest(60 - 10, 200 - 60) + 1e-9::DOUBLE) AS x FROM events)""",
"SELECT subject_id, event_type AS modality, avg(greatest(least(x, 2.5), -2.5)) AS signal FROM s GROUP BY 1, 2", "signal"))
def _signal(spark, sf):
    raw = J.risk_signal(F.col("value"), F.lit(10.0), F.lit(60.0), F.lit(200.0), ~F.col("event_type").isin("signup", "view"))
    return rounded(table(spark, sf, "events").groupBy(
        F.col("user_id").alias("subject_id"), F.col("event_type").alias("modality")).agg(F.avg(raw).alias("signal")))


@add("rank_within_class", """SELECT l_returnflag AS class, l_orderkey, l_linenumber, l_quantity, rk FROM (
  SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC) AS rk FROM lineitem) WHERE rk <= 2
 UNION ALL SELECT c_mktsegment, c_custkey, NULL, c_acctbal, rk FROM (
  SELECT *, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC) AS rk FROM customer) WHERE rk <= 2""")
def _rank_within(spark, sf):
    """Line items (whole classes tied at the maximum) and customers (few ties)."""
    li = table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "class")
    cu = table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("class"), F.col("c_custkey").alias("l_orderkey"),
        F.lit(None).cast("int").alias("l_linenumber"), F.col("c_acctbal").alias("l_quantity"))
    cols = ["class", "l_orderkey", "l_linenumber", "l_quantity", "rk"]
    return R.rank_within(li, "class", "l_quantity").select(*cols).unionByName(R.rank_within(cu, "class", "l_quantity").select(*cols))


@add("densest_window", f"""WITH {TRACE_SQL},
c AS (SELECT subject_id, ts, seq, count(*) OVER (PARTITION BY subject_id ORDER BY epoch_us(ts) RANGE BETWEEN CURRENT ROW AND 215999999999 FOLLOWING) AS n FROM clean)
SELECT subject_id, epoch_us(ts) AS start_us, n AS n_readings FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY n DESC, ts, seq) AS i FROM c) WHERE i = 1""")
def _densest(spark, sf):
    series = clean_series(trace_rows(spark, sf), "subject", "reading", "shown_at", "row_no")
    return R.densest_window(series).selectExpr("subject_id", "unix_micros(start_ts) AS start_us", "n_readings")


@add("set_union_dedupe", "SELECT c_custkey AS subject_id FROM customer UNION SELECT user_id FROM events UNION SELECT l_suppkey FROM lineitem")
def _union(spark, sf):
    return R.union_distinct([
        subjects(spark, sf).select("subject_id"), table(spark, sf, "events").select(F.col("user_id").alias("subject_id")),
        table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("subject_id"))])
