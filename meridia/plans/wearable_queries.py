"""Wearable and circadian features over the events table."""

from pyspark.sql import functions as F

from meridia.operators import circadian as C
from meridia.plans.catalog import Catalog, report_sql, rounded
from meridia.plans.tables import GRID_SQL, MINUTES_SQL, sensor_rows
from meridia.session import durable

catalog = Catalog()
GRID = MINUTES_SQL + "," + GRID_SQL
SUBJECTS = "(SELECT DISTINCT subject_id FROM minutes) u"


def minutes(spark, sf):
    return C.resample_minute(sensor_rows(spark, sf), ["hr", "accel", "skin_temp"])


def stored_minutes(spark, sf):
    """Written once: several features read it more than once."""
    return durable(minutes(spark, sf), "minutes")


def grid(spark, sf):
    return C.hour_grid(minutes(spark, sf), ["hr", "accel"])


@catalog.add("resample_minute", report_sql(
    MINUTES_SQL, "SELECT subject_id, epoch_us(ts) AS ts_us, hr, accel, skin_temp FROM minutes", "hr accel skin_temp"))
def _minutes(spark, sf):
    return rounded(minutes(spark, sf).selectExpr("subject_id", "unix_micros(ts) AS ts_us", "hr", "accel", "skin_temp"))


@catalog.add("resample_hour_grid", report_sql(
    GRID, "SELECT subject_id, idx, epoch_us(hour) AS hour_us, hr, accel FROM grid", "hr accel"))
def _grid(spark, sf):
    g = grid(spark, sf)
    return rounded(g.selectExpr("subject_id", "CAST(idx AS BIGINT) AS idx", "unix_micros(hour) AS hour_us", "hr", "accel"))


COVERAGE = """SELECT subject_id, count(hr) AS worn_minutes, count(hr) / 1440.0::DOUBLE AS worn_days,
  (max(epoch_us(ts)) - min(epoch_us(ts))) / 86400e6::DOUBLE AS span_days,
  count(hr) / ((max(epoch_us(ts)) - min(epoch_us(ts))) / 86400e6::DOUBLE * 1440 + 1) AS coverage_fraction FROM minutes GROUP BY 1"""
MEANS = """SELECT subject_id, avg(hr) AS hr_mean, coalesce(stddev_samp(hr), 0) AS hr_std, coalesce(avg(skin_temp), 0) AS skin_temp_mean,
  coalesce(avg(accel), 0) AS accel_mean FROM minutes GROUP BY 1"""


def cosinor_sql(channel, prefix):
    w = "2 * pi() / 24 * (hour(ts) + minute(ts) / 60.0::DOUBLE + second(ts) / 3600.0::DOUBLE)"
    return f"""SELECT subject_id, my - bc * mc - bs * ms AS {prefix}_mesor, sqrt(bc * bc + bs * bs) AS {prefix}_amplitude,
  (CASE WHEN atan2(bs, bc) < 0 THEN atan2(bs, bc) + 2 * pi() ELSE atan2(bs, bc) END) / (2 * pi() / 24) AS {prefix}_acrophase_h
FROM (SELECT *, (vss * vcy - vcs * vsy) / (vcc * vss - vcs * vcs) AS bc, (vcc * vsy - vcs * vcy) / (vcc * vss - vcs * vcs) AS bs
 FROM (SELECT subject_id, avg(y) AS my, avg(c) AS mc, avg(s) AS ms, covar_pop(c, c) AS vcc, covar_pop(s, s) AS vss,
   covar_pop(c, s) AS vcs, covar_pop(c, y) AS vcy, covar_pop(s, y) AS vsy
  FROM (SELECT subject_id, {channel} AS y, cos({w}) AS c, sin({w}) AS s FROM minutes WHERE {channel} IS NOT NULL) GROUP BY 1))"""


def rhythm_sql(channel, prefix):
    return f"""SELECT b.subject_id,
  CASE WHEN n >= 24 AND tss > 0 THEN n * between_ss / (24 * tss) ELSE 0 END AS {prefix}_is,
  CASE WHEN n >= 24 AND tss > 0 AND nd > 0 THEN n * dd / (nd * tss) ELSE 0 END AS {prefix}_iv
FROM (SELECT subject_id, count({channel}) AS n, avg({channel}) AS xbar, var_pop({channel}) * count({channel}) AS tss FROM grid GROUP BY 1) b
JOIN (SELECT p.subject_id, sum(pow(m - xb, 2)) AS between_ss
  FROM (SELECT subject_id, idx % 24 AS bin, avg({channel}) AS m FROM grid GROUP BY 1, 2) p
  JOIN (SELECT subject_id, avg({channel}) AS xb FROM grid GROUP BY 1) q ON q.subject_id = p.subject_id GROUP BY 1) w ON w.subject_id = b.subject_id
JOIN (SELECT subject_id, sum(d * d) AS dd, count(d) AS nd FROM (
  SELECT subject_id, {channel} - lag({channel}) OVER (PARTITION BY subject_id ORDER BY idx) AS d FROM grid) GROUP BY 1) m ON m.subject_id = b.subject_id"""


AMPLITUDE = """SELECT subject_id, coalesce((hi - lo) / nullif(hi + lo, 0), 0) AS accel_ra FROM (
  SELECT subject_id, list_avg(list_slice(p, 15, 24)) AS hi, list_avg(list_slice(p, 1, 5)) AS lo FROM (
    SELECT subject_id, list(m ORDER BY m) AS p FROM (SELECT subject_id, idx % 24 AS bin, avg(accel) AS m FROM grid GROUP BY 1, 2) GROUP BY 1))"""
RESTING = "SELECT subject_id, quantile_cont(hr, 0.05) AS resting_hr FROM minutes GROUP BY 1"
ROLLED = """SELECT subject_id, ts, CASE WHEN count(hr) OVER w >= 15 THEN avg(hr) OVER w END AS roll
  FROM minutes WINDOW w AS (PARTITION BY subject_id ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"""
DIP = f"""SELECT subject_id, low AS nightly_min_hr, m - low AS hr_dip, CASE WHEN m > 0 THEN (m - low) / m ELSE 0 END AS hr_dip_frac
FROM (SELECT subject_id, coalesce(avg(l), 0) AS low FROM (SELECT subject_id, ts::DATE AS day, min(roll) AS l FROM ({ROLLED}) GROUP BY 1, 2) GROUP BY 1)
JOIN (SELECT subject_id, avg(hr) AS m FROM minutes GROUP BY 1) USING (subject_id)"""
ACTIVITY = """SELECT subject_id, count(*) FILTER (WHERE accel > 800) / (count(hr) / 1440.0::DOUBLE) AS mvpa_min_per_day,
  count(*) FILTER (WHERE accel < 100) / (count(hr) / 1440.0::DOUBLE) AS sedentary_min_per_day FROM minutes GROUP BY 1"""


def runs_sql(flag, name):
    return f"""SELECT subject_id, count(*) FILTER (WHERE f) AS {name}_rows, count(*) FILTER (WHERE f AND NOT coalesce(was, false)) AS {name}_runs,
  coalesce(count(*) FILTER (WHERE f) / nullif(count(*) FILTER (WHERE f AND NOT coalesce(was, false)), 0)::DOUBLE, 0) AS {name}_mean_run
FROM (SELECT *, lag(f) OVER (PARTITION BY subject_id ORDER BY ts) AS was FROM (
  SELECT subject_id, ts, {flag} AS f FROM minutes WHERE accel IS NOT NULL)) GROUP BY 1"""


BOUTS = f"""SELECT u.subject_id, coalesce(still_mean_run, 0) AS sedentary_bout_mean_min, coalesce(active_runs / active_rows::DOUBLE, 0) AS activity_fragmentation
FROM {SUBJECTS} LEFT JOIN ({runs_sql('accel < 100', 'still')}) s ON s.subject_id = u.subject_id
LEFT JOIN ({runs_sql('accel >= 100', 'active')}) a ON a.subject_id = u.subject_id"""
BEATS = """SELECT subject_id, coalesce(sqrt(avg(d * d)), 0) AS hr_rmssd, coalesce(stddev_samp(hr), 0) AS hr_sdnn FROM (
  SELECT subject_id, hr, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) = 60000000 THEN hr - lag(hr) OVER w END AS d
  FROM minutes WINDOW w AS (PARTITION BY subject_id ORDER BY ts)) GROUP BY 1"""
DAYS = """SELECT subject_id, coalesce(avg(sd), 0) AS hr_within_day_std,
  coalesce(CASE WHEN count(*) > 1 AND avg(m) > 0 THEN stddev_samp(m) / avg(m) END, 0) AS hr_day_to_day_cv
FROM (SELECT subject_id, ts::DATE AS day, stddev_samp(hr) AS sd, avg(hr) AS m FROM minutes GROUP BY 1, 2) GROUP BY 1"""
REGULAR = f"""SELECT u.subject_id, coalesce(r.c, 0) AS hr_profile_regularity FROM {SUBJECTS} LEFT JOIN (
 SELECT subject_id, CASE WHEN count(*) >= 2 THEN avg(c) END AS c FROM (
  SELECT a.subject_id, a.day, CASE WHEN count(*) >= 3 AND stddev_samp(v) > 0 AND stddev_samp(o) > 0 THEN corr(v, o) END AS c
  FROM (SELECT subject_id, ts::DATE AS day, hour(ts) AS h, avg(hr) AS v FROM minutes GROUP BY 1, 2, 3) a
  JOIN (SELECT subject_id, h, avg(v) AS o FROM (SELECT subject_id, ts::DATE AS day, hour(ts) AS h, avg(hr) AS v FROM minutes GROUP BY 1, 2, 3) GROUP BY 1, 2) b
  ON a.subject_id = b.subject_id AND a.h = b.h GROUP BY 1, 2) GROUP BY 1) r ON r.subject_id = u.subject_id"""


def _minute_query(name, sql, doubles, fn, stored=False):
    source = stored_minutes if stored else minutes
    catalog.add(name, report_sql(MINUTES_SQL, sql, doubles))(lambda spark, sf: rounded(fn(source(spark, sf))))


_minute_query("wear_coverage", COVERAGE, "worn_days span_days coverage_fraction", C.wear_coverage)
_minute_query("sensor_means", MEANS, "hr_mean hr_std skin_temp_mean accel_mean", C.sensor_means)
_minute_query("cosinor_fit", cosinor_sql("hr", "hr"), "hr_mesor hr_amplitude hr_acrophase_h",
              lambda m: C.cosinor_fit(m, "hr", "hr"))
_minute_query("resting_hr", RESTING, "resting_hr", C.resting_rate)
_minute_query("rolling_mean_rows", ROLLED.replace("ts, CASE", "epoch_us(ts) AS ts_us, CASE"), "roll",
              lambda m: C.rolling_mean(m, "hr", "roll").selectExpr("subject_id", "unix_micros(ts) AS ts_us", "roll"))
_minute_query("nightly_low_dip", DIP, "nightly_min_hr hr_dip hr_dip_frac", C.nightly_dip)
_minute_query("activity_minutes", ACTIVITY, "mvpa_min_per_day sedentary_min_per_day", C.activity_minutes)
_minute_query("run_length_islands", runs_sql("accel < 100", "still"), "still_mean_run",
              lambda m: C.runs(m, F.col("accel") < C.SEDENTARY_BELOW, "still"))
_minute_query("activity_bouts", BOUTS, "sedentary_bout_mean_min activity_fragmentation", C.activity_bouts)
_minute_query("hr_rmssd", BEATS, "hr_rmssd hr_sdnn", C.beat_variability)
_minute_query("hr_day_variability", DAYS, "hr_within_day_std hr_day_to_day_cv", C.day_variability)
_minute_query("hr_profile_regularity", REGULAR, "hr_profile_regularity", C.profile_regularity)
_minute_query("wear_summary", """SELECT subject_id, count(hr) AS worn_minutes, round(count(hr) / 1440.0::DOUBLE, 1) AS worn_days
  FROM minutes GROUP BY 1""", "worn_days", C.wear_summary)
_minute_query("circadian_profile", f"""SELECT h.hour, m.mean, m.sem, f.c_mesor + f.c_amplitude * cos(2 * pi() / 24 * (h.hour - f.c_acrophase_h)) AS fitted
FROM (SELECT unnest(range(24))::INT AS hour) h LEFT JOIN (
  SELECT hour(ts) AS hour, avg(hr) AS mean, stddev_samp(hr) / sqrt(count(hr)) AS sem FROM minutes GROUP BY 1) m ON m.hour = h.hour,
 ({cosinor_sql('hr', 'c').replace('SELECT subject_id, hr AS y', 'SELECT 0 AS subject_id, hr AS y')}) f""", "mean sem fitted",
              lambda m: C.circadian_profile(m, "hr"))


@catalog.add("interdaily_stability", report_sql(
    GRID, f"SELECT subject_id, hr_is FROM ({rhythm_sql('hr', 'hr')})", "hr_is"))
def _is(spark, sf):
    return rounded(C.rhythm(grid(spark, sf), {"hr": "hr"}).select("subject_id", "hr_is"))


@catalog.add("intradaily_variability", report_sql(
    GRID, f"SELECT subject_id, hr_iv FROM ({rhythm_sql('hr', 'hr')})", "hr_iv"))
def _iv(spark, sf):
    return rounded(C.rhythm(grid(spark, sf), {"hr": "hr"}).select("subject_id", "hr_iv"))


@catalog.add("relative_amplitude", report_sql(GRID, AMPLITUDE, "accel_ra"))
def _ra(spark, sf):
    return rounded(C.relative_amplitude(grid(spark, sf), "accel"))


@catalog.add("wearable_matrix", report_sql(
    GRID,
    "SELECT subject_id, " + ", ".join(C.FEATURES) + " FROM " + " JOIN ".join(
        f"({q}) t{i}" + (" USING (subject_id)" if i else "") for i, q in enumerate([
            COVERAGE, MEANS, cosinor_sql("hr", "hr"), cosinor_sql("skin_temp", "temp"), rhythm_sql("hr", "hr"),
            rhythm_sql("accel", "accel"), AMPLITUDE, RESTING, DIP, ACTIVITY, BOUTS, BEATS, DAYS, REGULAR])),
    " ".join(f for f in C.FEATURES if f != "worn_minutes")))
def wearable_matrix(spark, sf):
    return rounded(C.wearable_matrix(stored_minutes(spark, sf)))
