"""How the given tables stand in for subjects, readings and feature matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.functions.columns import exact_mean
from meridia.session import durable


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def trace_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Glucose-like rows as text, the way a sensor export arrives."""
    return table(spark, sf, "events").select(
        F.pmod("user_id", F.lit(8)).alias("subject"),
        F.col("ts").cast("string").alias("shown_at"),
        F.when(F.col("event_type") == "error", F.lit("Low")).otherwise(F.col("value").cast("string")).alias("reading"),
        F.col("event_id").alias("row_no"),
    )


TRACE_SQL = """
raw AS (SELECT user_id % 8 AS subject_id, ts, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS g, event_id AS seq FROM events),
clean AS (SELECT * FROM raw WHERE g IS NOT NULL)"""


def sensor_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Wearable-like readings: heart rate, movement (missing in one event type) and skin temperature."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("double")
    return table(spark, sf, "events").select(
        F.pmod("user_id", F.lit(8)).alias("subject_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") != "signup", F.col("value")).alias("hr"),
        F.when(F.col("event_type") != "error", F.col("value") * 8.0).alias("accel"),
        (k * 0.2 + 80.0).alias("skin_temp"),
    )


MINUTES_SQL = """
sensed AS (SELECT user_id % 8 AS subject_id, ts,
   CASE WHEN event_type <> 'signup' THEN value END AS hr,
   CASE WHEN event_type <> 'error' THEN value * 8.0::DOUBLE END AS accel,
   regexp_extract(props, '(\\d+)', 1)::DOUBLE * 0.2::DOUBLE + 80.0::DOUBLE AS skin_temp FROM events),
minutes AS (SELECT subject_id, date_trunc('minute', ts) AS ts, avg(hr) AS hr, avg(accel) AS accel, avg(skin_temp) AS skin_temp
   FROM sensed GROUP BY 1, 2 HAVING avg(hr) IS NOT NULL)"""

GRID_SQL = """
hourly AS (SELECT subject_id, date_trunc('hour', ts) AS hour, avg(hr) AS hr, avg(accel) AS accel FROM minutes GROUP BY 1, 2),
spine AS (SELECT subject_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS hour, lo
   FROM (SELECT subject_id, min(hour) AS lo, max(hour) AS hi FROM hourly GROUP BY 1)),
grid AS (SELECT s.subject_id, date_diff('hour', s.lo, s.hour) AS idx, s.hour, h.hr, h.accel
   FROM spine s LEFT JOIN hourly h ON h.subject_id = s.subject_id AND h.hour = s.hour)"""


def subjects(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as subjects: class = market segment, continuous label = balance (missing when negative)."""
    bal = F.col("c_acctbal")
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("subject_id"), F.col("c_mktsegment").alias("iris"),
        F.when(bal >= 0, bal).alias("sspg"), F.col("c_nationkey").alias("nation"),
    )


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as subjects with long features: panel = return flag, analyte = part bucket, mean quantity."""
    return table(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").alias("subject_id"), F.col("l_returnflag").alias("panel"),
        F.concat(F.lit("a"), F.pmod("l_partkey", F.lit(20)).cast("string")).alias("analyte"),
    ).agg(F.avg("l_quantity").alias("value"))


def holed_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Users x (event type, slot) mean values; a mean of 50 or more counts as missing, in whatever order rows are added."""
    m = exact_mean("value")
    return table(spark, sf, "events").groupBy(
        F.col("user_id").alias("subject_id"),
        F.concat("event_type", F.lit("_"), F.pmod("event_id", F.lit(8)).cast("string")).alias("analyte"),
    ).agg(F.when(m < 50, m).alias("value"))


def crosswalk(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as links between id systems; every fiftieth points to no subject."""
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.when(key % 50 == 0, F.col("o_custkey") + 1000000).otherwise(F.col("o_custkey")).alias("omics_subject_id"),
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("1636-"), key.cast("string"))).alias("cgm_subject_id"),
        key.cast("string").alias("site_code"), F.col("o_orderpriority").alias("wearable_subject_id"),
    )


STORE_SQL = """
subjects AS (SELECT c_custkey AS subject_id, c_mktsegment AS iris, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS sspg, c_nationkey AS nation FROM customer),
cells AS (SELECT l_suppkey AS subject_id, l_returnflag AS panel, 'a' || (l_partkey % 20) AS analyte, avg(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3),
holed AS (SELECT user_id AS subject_id, event_type || '_' || (event_id % 8) AS analyte,
  CASE WHEN avg(value) < 50 THEN avg(value) END AS value FROM events GROUP BY 1, 2),
crosswalk AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS omics_subject_id,
  CASE WHEN o_orderstatus <> 'P' THEN '1636-' || o_orderkey END AS cgm_subject_id, o_orderkey::VARCHAR AS site_code,
  o_orderpriority AS wearable_subject_id FROM orders)"""


def traits(spark: SparkSession, sf: str) -> DataFrame:
    """Wide per-subject matrix from order totals: two panels' worth of columns and a ratio-safe pair."""
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("subject_id")).agg(
        F.avg("l_quantity").alias("quantity"), F.avg("l_extendedprice").alias("TGL"),
        F.avg("l_discount").alias("HDL"), F.avg("l_tax").alias("tax"),
        F.max(F.lit(1.0)).alias("constant"),
    )


TRAITS_SQL = """
traits AS (SELECT l_suppkey AS subject_id, avg(l_quantity) AS quantity, avg(l_extendedprice) AS TGL, avg(l_discount) AS HDL,
  avg(l_tax) AS tax, 1.0::DOUBLE AS constant FROM lineitem GROUP BY 1)"""


def order_totals(spark: SparkSession, sf: str) -> DataFrame:
    """One feature, one label per order: total quantity and total price; written once, as fits read it again."""
    return durable(table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(
        F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("y")
    ).select("key", F.pmod("key", F.lit(5)).alias("fold"), F.array("q").alias("x"), "y"), "orders")


ORDER_SQL = """
t AS (SELECT l_orderkey AS key, l_orderkey % 5 AS fold, sum(l_quantity) AS x, sum(l_extendedprice) AS y FROM lineitem GROUP BY 1, 2)"""


def vectors(spark: SparkSession, sf: str, k: int = 5) -> DataFrame:
    """Embeddings as a feature matrix with two sets of folds; the label mixes three of its entries and the class."""
    from meridia.operators.models import hash_fold

    e = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("key"), e.alias("x"), (e[0] * 10.0 - e[1] * 6.0 + e[2] * 4.0 + F.col("label") * 0.1).alias("y"),
        hash_fold("vec_id", k).alias("fold"), hash_fold("vec_id", k, 1).alias("inner"),
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Regression predictions: price by quantity, one group per return flag."""
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("target"), F.col("l_extendedprice").alias("y_true"),
        (F.col("l_quantity") * 1500.0 + F.col("l_discount") * 10000.0).alias("y_pred"),
    )


def risks(spark: SparkSession, sf: str) -> DataFrame:
    """Binary outcome with a score in [0, 1]: document quality and clipped length."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return table(spark, sf, "labels").join(docs, "doc_id").select(
        "doc_id", F.col("quality").alias("y_true"), F.least(F.col("n_chars") / 4000.0, F.lit(1.0)).alias("y_pred"))


SCORE_SQL = """
preds AS (SELECT l_returnflag AS target, l_extendedprice AS y_true, l_quantity * 1500.0::DOUBLE + l_discount * 10000.0::DOUBLE AS y_pred FROM lineitem),
risks AS (SELECT l.doc_id, l.quality AS y_true, least(d.n_chars / 4000.0::DOUBLE, 1) AS y_pred FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""
