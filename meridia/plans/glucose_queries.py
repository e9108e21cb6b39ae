"""Glucose metrics over the events table."""

from meridia.operators import glucose as G
from meridia.plans.catalog import Catalog, report_sql, rounded
from meridia.plans.tables import TRACE_SQL, trace_rows

catalog = Catalog()

PLACED = TRACE_SQL + """,
placed AS (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY subject_id) AS n,
   lag(g) OVER w AS gp, lag(ts) OVER w AS tp, lead(g) OVER w AS gn
   FROM clean WINDOW w AS (PARTITION BY subject_id ORDER BY ts NULLS LAST, seq)),
interval_of AS (SELECT s.subject_id, coalesce(i.m, 5.0::DOUBLE) AS interval_min
   FROM (SELECT DISTINCT subject_id FROM clean) s LEFT JOIN (
     SELECT subject_id, quantile_cont((epoch_us(ts) - epoch_us(tp)) / 6e7::DOUBLE, 0.5) AS m FROM placed WHERE ts > tp GROUP BY 1) i
   ON i.subject_id = s.subject_id)"""
MAGE = """
stats AS (SELECT subject_id, coalesce(stddev_samp(g), 0) AS sd FROM clean GROUP BY 1),
turning AS (SELECT subject_id, pos, g FROM placed WHERE n >= 3 AND (pos = 1 OR pos = n OR (g - gp) * (gn - g) < 0)),
swings AS (SELECT subject_id, abs(g - lag(g) OVER (PARTITION BY subject_id ORDER BY pos)) AS swing FROM turning),
mage AS (SELECT st.subject_id, coalesce(avg(sw.swing) FILTER (WHERE sw.swing > st.sd), 0) AS mage
   FROM stats st LEFT JOIN swings sw ON sw.subject_id = st.subject_id GROUP BY 1)"""
LAGS = """
steps AS (SELECT subject_id, l.lag, round_even(l.minutes / interval_min, 0)::BIGINT AS k
   FROM interval_of, (VALUES ('conga', 60.0::DOUBLE), ('modd', 1440.0::DOUBLE)) l(lag, minutes)),
diffs AS (SELECT a.subject_id, s.lag, s.k, a.pos, b.g - a.g AS diff FROM placed a
   JOIN steps s ON s.subject_id = a.subject_id AND s.k >= 1
   JOIN placed b ON b.subject_id = a.subject_id AND b.pos = a.pos + s.k),
lagged AS (SELECT p.subject_id, stddev_samp(diff) FILTER (WHERE lag = 'conga') AS conga1,
   avg(abs(diff)) FILTER (WHERE lag = 'modd') AS modd
   FROM (SELECT DISTINCT subject_id FROM placed) p LEFT JOIN diffs d ON d.subject_id = p.subject_id GROUP BY 1)"""
RISK = """
risk AS (SELECT subject_id, 1.509::DOUBLE * (pow(ln(greatest(g, 1.0::DOUBLE)), 1.084::DOUBLE) - 5.381::DOUBLE) AS f FROM clean),
risks AS (SELECT subject_id, avg(CASE WHEN f < 0 THEN 10 * f * f ELSE 0 END) AS lbgi,
   avg(CASE WHEN f > 0 THEN 10 * f * f ELSE 0 END) AS hbgi FROM risk GROUP BY 1)"""
MEAN_SD = "avg(g) AS mean_glucose, coalesce(stddev_samp(g), 0) AS sd_glucose, coalesce(stddev_samp(g), 0) / nullif(avg(g), 0) * 100 AS cv_glucose"
RANGES = "avg((g >= 70 AND g <= 180)::INT) AS tir, avg((g > 180)::INT) AS tar, avg((g < 70)::INT) AS tbr"
J_INDEX = "0.001::DOUBLE * pow(avg(g) + coalesce(stddev_samp(g), 0), 2) AS j_index"
GMI = "3.31::DOUBLE + 0.02392::DOUBLE * avg(g) AS gmi"
IQR = "quantile_cont(g, 0.75) - quantile_cont(g, 0.25) AS iqr_glucose"


def series(spark, sf):
    return G.clean_series(trace_rows(spark, sf), "subject", "reading", "shown_at", "row_no")


def placed(spark, sf):
    return G.trace(series(spark, sf))


@catalog.add("clean_series", report_sql(TRACE_SQL, "SELECT subject_id, epoch_us(ts) AS ts_us, g, seq FROM clean"))
def _clean(spark, sf):
    return series(spark, sf).selectExpr("subject_id", "unix_micros(ts) AS ts_us", "g", "seq")


def _simple(name, aggs, select, doubles):
    sql = report_sql(TRACE_SQL, f"SELECT subject_id, {select} FROM clean GROUP BY 1", doubles)
    catalog.add(name, sql)(lambda spark, sf: rounded(G.per_subject(series(spark, sf), aggs())))


_simple("cgm_moments", G.moment_aggs, MEAN_SD, "mean_glucose sd_glucose cv_glucose")
_simple("cgm_j_index", lambda: [G.j_index_agg()], J_INDEX, "j_index")
_simple("cgm_time_in_range", G.range_aggs, RANGES, "tir tar tbr")
_simple("cgm_gmi", lambda: [G.gmi_agg()], GMI, "gmi")


@catalog.add("cgm_iqr", report_sql(TRACE_SQL, f"SELECT subject_id, {IQR} FROM clean GROUP BY 1", "iqr_glucose"))
def _iqr(spark, sf):
    return rounded(G.iqr(series(spark, sf)))


@catalog.add("cgm_risk_indices", report_sql(TRACE_SQL + "," + RISK, "SELECT * FROM risks", "lbgi hbgi"))
def _risk(spark, sf):
    return rounded(G.per_subject(series(spark, sf), G.risk_aggs()))


@catalog.add("cgm_sampling_interval", report_sql(PLACED, "SELECT * FROM interval_of", "interval_min"))
def _interval(spark, sf):
    return rounded(G.sampling_interval(placed(spark, sf)))


@catalog.add("cgm_mage", report_sql(PLACED + "," + MAGE, "SELECT * FROM mage", "mage"))
def _mage(spark, sf):
    return rounded(G.mage(placed(spark, sf)))


@catalog.add("cgm_lag_diff", report_sql(PLACED + "," + LAGS, "SELECT * FROM diffs", "diff"))
def _lags(spark, sf):
    return rounded(G.lag_differences(placed(spark, sf), {"conga": 1.0, "modd": 24.0}))


@catalog.add("cgm_conga", report_sql(PLACED + "," + LAGS, "SELECT subject_id, conga1 FROM lagged", "conga1"))
def _conga(spark, sf):
    return rounded(G.lag_metrics(placed(spark, sf)).select("subject_id", "conga1"))


@catalog.add("cgm_modd", report_sql(PLACED + "," + LAGS, "SELECT subject_id, modd FROM lagged", "modd"))
def _modd(spark, sf):
    return rounded(G.lag_metrics(placed(spark, sf)).select("subject_id", "modd"))


@catalog.add("cgm_matrix", report_sql(
    PLACED + "," + MAGE + "," + LAGS + "," + RISK + f""",
simple AS (SELECT subject_id, {MEAN_SD}, {IQR}, {J_INDEX}, {RANGES}, {GMI} FROM clean GROUP BY 1)""",
    """SELECT r.subject_id, mean_glucose, sd_glucose, cv_glucose, iqr_glucose, mage, conga1, modd, j_index, tir, tar, tbr, lbgi, hbgi, gmi
FROM (SELECT DISTINCT subject_id FROM raw) r LEFT JOIN simple s ON s.subject_id = r.subject_id LEFT JOIN mage m ON m.subject_id = r.subject_id
LEFT JOIN lagged l ON l.subject_id = r.subject_id LEFT JOIN risks k ON k.subject_id = r.subject_id""",
    " ".join(G.FEATURES)))
def glucose_matrix(spark, sf):
    return rounded(G.glucose_matrix(trace_rows(spark, sf), "subject", "reading", "shown_at", "row_no"))
