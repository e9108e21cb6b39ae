"""Cleaning, missing-value and quality-check queries."""

from pyspark.sql import functions as F

from meridia.functions.columns import clip, to_number, to_utc
from meridia.operators import clean as K
from meridia.plans.catalog import Catalog, report_sql, rounded
from meridia.plans.tables import (
    STORE_SQL, TRAITS_SQL, cells, crosswalk, holed_cells, subjects, table, trace_rows, traits,
)

catalog = Catalog()
add = catalog.add


@add("coerce_numeric", "SELECT event_id AS row_no, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS reading FROM events")
def _numeric(spark, sf):
    return trace_rows(spark, sf).select("row_no", to_number("reading").alias("reading"))


@add("coerce_timestamp_utc", "SELECT event_id AS row_no, CASE WHEN event_type <> 'error' THEN epoch_us(ts) END AS ts_us FROM events")
def _utc(spark, sf):
    shown = F.when(F.col("reading") == "Low", F.concat(F.lit("at "), F.col("shown_at"))).otherwise(F.col("shown_at"))
    rows = trace_rows(spark, sf).withColumn("shown_at", shown)
    return rows.select("row_no", F.unix_micros(to_utc("shown_at")).alias("ts_us"))


@add("staging_typed_distinct", """SELECT DISTINCT o_custkey::VARCHAR AS o_custkey, upper(o_orderstatus) AS o_orderstatus,
  TRY_CAST(o_orderpriority AS DOUBLE) AS o_orderpriority FROM orders WHERE o_custkey IS NOT NULL""")
def _staging(spark, sf):
    return K.staging_distinct(table(spark, sf, "orders"), "o_custkey", ["o_orderstatus"], ["o_orderpriority"])


@add("drop_missing_label", f"WITH {STORE_SQL} SELECT subject_id, sspg AS SSPG, nation::DOUBLE AS nation FROM subjects WHERE sspg IS NOT NULL")
def _labelled(spark, sf):
    return K.feature_matrix(subjects(spark, sf).withColumnRenamed("sspg", "SSPG"), "subject_id", "SSPG", ["nation"])


@add("ratio_feature", report_sql(TRAITS_SQL, """SELECT subject_id, TGL, HDL,
  CASE WHEN (SELECT bool_or(HDL = 0) FROM traits) THEN NULL ELSE TGL / nullif(HDL, 0) END AS TG_HDL_ratio FROM traits""", "TGL HDL TG_HDL_ratio", 4))
def _ratio(spark, sf):
    return rounded(K.add_ratio(traits(spark, sf).select("subject_id", "TGL", "HDL"), "TGL", "HDL", "TG_HDL_ratio"), 4)


@add("attach_target", report_sql(STORE_SQL + "," + TRAITS_SQL, """SELECT t.subject_id, t.quantity, t.tax, s.sspg FROM traits t
  JOIN subjects s ON s.subject_id = t.subject_id""", "quantity tax sspg"))
def _attach(spark, sf):
    return rounded(K.attach_target(traits(spark, sf).select("subject_id", "quantity", "tax"), subjects(spark, sf), "subject_id", "sspg"))


@add("subject_in_filter", """SELECT event_id, user_id AS subject_id, value FROM events
  WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def _semi(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.col("user_id").alias("subject_id"), "value")
    return K.subjects_in(rows, subjects(spark, sf).where("iris = 'BUILDING'"), "subject_id")


@add("derive_join_key", """SELECT c_custkey AS subject_id, (c_nationkey + 10) || '-' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') AS site_code,
  'Z' || lpad(c_custkey::VARCHAR, 6, '0') AS zcode FROM customer""")
def _keys(spark, sf):
    header = F.concat(
        F.lit("1636-"), (F.col("nation") + 10).cast("string"), F.lit("-"),
        F.lpad(F.pmod("subject_id", F.lit(1000)).cast("string"), 3, "0"),
        F.lit("/Z"), F.lpad(F.col("subject_id").cast("string"), 6, "0"),
    )
    return subjects(spark, sf).withColumn("header", header).select("subject_id", *K.join_key("header"))


@add("clip_range", "SELECT event_id, least(greatest(value, 70), 180) AS clipped FROM events")
def _clip(spark, sf):
    return table(spark, sf, "events").select("event_id", clip(F.col("value"), 70.0, 180.0).alias("clipped"))


@add("missingness_profile", report_sql(STORE_SQL, """SELECT 'analyte' AS kind, analyte AS name, 1 - count(value) / (SELECT count(DISTINCT subject_id) FROM holed) AS missing_fraction FROM holed GROUP BY 2
  UNION ALL SELECT 'subject_id', subject_id::VARCHAR, 1 - count(value) / (SELECT count(DISTINCT analyte) FROM holed) FROM holed GROUP BY 2""", "missing_fraction"))
def _profile(spark, sf):
    return rounded(K.missingness_profile(holed_cells(spark, sf)))


@add("missingness_summary", report_sql(STORE_SQL + """,
a AS (SELECT analyte, 1 - count(value) / (SELECT count(DISTINCT subject_id) FROM holed) AS m FROM holed GROUP BY 1),
s AS (SELECT subject_id, 1 - count(value) / (SELECT count(DISTINCT analyte) FROM holed) AS m FROM holed GROUP BY 1),
g AS (SELECT count(DISTINCT subject_id) * count(DISTINCT analyte) AS n, count(value) AS v FROM holed)""",
"""SELECT (SELECT n FROM g) AS n_cells, (SELECT n - v FROM g) AS n_missing,
 (SELECT count(*) FROM a WHERE m > 0.5) AS analytes_over_50, (SELECT count(*) FROM a WHERE m > 0.2) AS analytes_over_20,
 count(*) AS n_patients, avg(m) AS mean, stddev_samp(m) AS sd, min(m) AS min, max(m) AS max, count(*) FILTER (WHERE m > 0.5) AS patients_over_50,
 quantile_cont(m, 0.25) AS p25, quantile_cont(m, 0.5) AS p50, quantile_cont(m, 0.75) AS p75 FROM s""", "mean sd min max p25 p50 p75"))
def _summary(spark, sf):
    return rounded(K.missingness_summary(holed_cells(spark, sf)))


@add("missingness_worst", report_sql(STORE_SQL, """SELECT analyte, 1 - count(value) / (SELECT count(DISTINCT subject_id) FROM holed) AS missing_fraction FROM holed GROUP BY 1
  ORDER BY 2 DESC, 1 LIMIT 5""", "missing_fraction"))
def _worst(spark, sf):
    return rounded(K.worst_missing(holed_cells(spark, sf), "analyte"))


KEPT = """,
kept AS (SELECT * FROM holed WHERE subject_id IN (SELECT subject_id FROM holed GROUP BY 1
  HAVING 1 - count(value) / (SELECT count(DISTINCT analyte) FROM holed) <= 0.5))"""


@add("drop_sparse_patients", report_sql(STORE_SQL + KEPT, "SELECT * FROM kept", "value"))
def _sparse(spark, sf):
    return rounded(K.drop_sparse(holed_cells(spark, sf)))


@add("impute_median", report_sql(STORE_SQL + KEPT + ", med AS (SELECT analyte, quantile_cont(value, 0.5) AS m FROM kept GROUP BY 1)",
     """SELECT s.subject_id, m.analyte, coalesce(k.value, m.m) AS value FROM (SELECT DISTINCT subject_id FROM kept) s CROSS JOIN med m
  LEFT JOIN kept k ON k.subject_id = s.subject_id AND k.analyte = m.analyte""", "value"))
def _impute(spark, sf):
    return rounded(K.impute(K.drop_sparse(holed_cells(spark, sf))))


def sheet(spark, sf):
    """Analytes x patients sheet (patients = nations) with the label row among the analyte rows."""
    rows = table(spark, sf, "customer").select(
        "c_mktsegment", "c_acctbal", F.concat(F.lit("Z"), F.lpad(F.col("c_nationkey").cast("string"), 6, "0")).alias("p")
    )
    patients = [f"Z{i:06d}" for i in range(25)]
    body = rows.groupBy(F.col("c_mktsegment").alias("row_label")).pivot("p", patients).agg(F.avg("c_acctbal"))
    label = rows.groupBy(F.lit("SSPG").alias("row_label")).pivot("p", patients).agg(F.max("c_acctbal"))
    return body.unionByName(label).withColumn("All", F.lit(0.0))


@add("split_label_row", report_sql("""
p AS (SELECT 'Z' || lpad(c_nationkey::VARCHAR, 6, '0') AS subject_id, c_mktsegment, c_acctbal FROM customer)""",
"""SELECT c.subject_id, l.label, c.analyte, c.value FROM (SELECT subject_id, c_mktsegment AS analyte, avg(c_acctbal) AS value FROM p GROUP BY 1, 2) c
 JOIN (SELECT subject_id, max(c_acctbal) AS label FROM p GROUP BY 1) l ON l.subject_id = c.subject_id""", "label value"))
def _split(spark, sf):
    s = sheet(spark, sf)
    long = s.unpivot(["row_label"], [c for c in s.columns if c != "row_label"], "column", "value")
    labels, body = K.split_sheet(long, "SSPG")
    return rounded(body.join(labels, "subject_id").select("subject_id", "label", "analyte", "value"))


@add("range_qc", """WITH d AS (SELECT l_discount * 15 - 0.2::DOUBLE AS a, l_tax * 13 AS b, l_tax - 0.01::DOUBLE AS c,
  CASE WHEN l_linenumber > 1 THEN l_quantity END AS q FROM lineitem)
 SELECT count(*) FILTER (WHERE q IS NULL) AS missing, count(*) FILTER (WHERE a < -1 OR a > 1) AS r_out_of_range,
  count(*) FILTER (WHERE b < 0 OR b > 1) + count(*) FILTER (WHERE c < 0 OR c > 1) AS p_out_of_range, false AS ok FROM d""")
def _qc(spark, sf):
    li = table(spark, sf, "lineitem")
    return K.range_qc(li.select(
        (F.col("l_discount") * 15 - 0.2).alias("cor_r_price"), (F.col("l_tax") * 13).alias("cor_p_price"),
        (F.col("l_tax") - 0.01).alias("adj.p_price"), F.when(F.col("l_linenumber") > 1, F.col("l_quantity")).alias("quantity"),
    ))


@add("dq_assertions", f"""WITH {STORE_SQL} SELECT (SELECT count(*) FROM subjects WHERE sspg IS NULL) AS null_sspg,
  (SELECT count(*) FROM cells WHERE value < 0) AS negative_values,
  (SELECT count(*) FROM crosswalk c WHERE NOT EXISTS (SELECT 1 FROM subjects s WHERE s.subject_id = c.omics_subject_id)) AS orphan_crosswalk""")
def _dq(spark, sf):
    return K.dq_assertions(subjects(spark, sf), cells(spark, sf), crosswalk(spark, sf))


@add("dq_unique_key", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _unique(spark, sf):
    return K.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


PROFILE_COLUMNS = ["quantity", "TGL", "HDL", "tax", "constant"]


@add("finite_columns", f"WITH {TRAITS_SQL} " + " UNION ALL ".join(
    f'SELECT \'{c}\' AS "column", bool_and({c} IS NOT NULL AND isfinite({c})) AS all_finite FROM traits' for c in PROFILE_COLUMNS))
def _finite(spark, sf):
    return K.column_profile(traits(spark, sf), PROFILE_COLUMNS).select("column", "all_finite")


@add("varying_columns", f"WITH {TRAITS_SQL} " + " UNION ALL ".join(
    f'SELECT \'{c}\' AS "column", count(DISTINCT {c}) > 1 AS varying FROM traits' for c in PROFILE_COLUMNS))
def _varying(spark, sf):
    return K.column_profile(traits(spark, sf), PROFILE_COLUMNS).select("column", "varying")
