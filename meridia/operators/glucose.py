"""Glucose-variability metrics, one row per subject.

Readings are ordered once with :func:`meridia.operators.ordered.ordered`, so a
subject with a third of all rows is still spread over many tasks; every metric
is then an aggregate or an equi-join on (subject, position).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.functions.columns import micros, ratio, to_number, to_utc
from meridia.operators.ordered import ordered, quantiles
from meridia.session import durable

# Fixed values of the metric definitions.
DEFAULT_GAP_MINUTES = 5.0
RANGE_LOW = 70.0
RANGE_HIGH = 180.0
FEATURES = [
    "mean_glucose", "sd_glucose", "cv_glucose", "iqr_glucose",
    "mage", "conga1", "modd", "j_index",
    "tir", "tar", "tbr", "lbgi", "hbgi", "gmi",
]

ORDER = ["ts_missing", "ts", "seq"]


def require_columns(df: DataFrame, needed: list[str]) -> None:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")


def clean_series(df: DataFrame, subject: str, value: str, ts: str | None, seq: str) -> DataFrame:
    """subject_id, ts, g, seq with unparseable readings dropped; unparseable times sort last.

    Without a time column the rows keep their input ordinal ``seq``.
    """
    require_columns(df, [c for c in (subject, value, ts, seq) if c])
    when = to_utc(ts) if ts else F.lit(None).cast("timestamp")
    return df.select(
        F.col(subject).alias("subject_id"), when.alias("ts"), to_number(value).alias("g"),
        F.col(seq).alias("seq"),
    ).where(F.col("g").isNotNull())


def trace(series: DataFrame) -> DataFrame:
    """The cleaned series with position, series length and both neighbours, stored once."""
    keyed = series.withColumn("ts_missing", F.col("ts").isNull().cast("int"))
    placed = ordered(
        keyed, ["subject_id"], ORDER, pos="pos", totals=True,
        lag={"g_prev": "g", "ts_prev": "ts"}, lead={"g_next": "g"},
    )
    return durable(placed.withColumnRenamed("pos_total", "n"), "trace")


def _mean_sd() -> tuple[Column, Column]:
    return F.avg("g"), F.coalesce(F.stddev_samp("g"), F.lit(0.0))


def moment_aggs() -> list[Column]:
    mean, sd = _mean_sd()
    return [
        mean.alias("mean_glucose"), sd.alias("sd_glucose"),
        (ratio(sd, mean) * 100.0).alias("cv_glucose"),
    ]


def range_aggs(low: float = RANGE_LOW, high: float = RANGE_HIGH) -> list[Column]:
    g = F.col("g")

    def share(cond: Column) -> Column:
        return F.avg(cond.cast("double"))

    return [
        share((g >= low) & (g <= high)).alias("tir"),
        share(g > high).alias("tar"),
        share(g < low).alias("tbr"),
    ]


def risk_aggs() -> list[Column]:
    # symmetrising transform of the published blood-glucose risk function
    f = (F.pow(F.log(F.greatest(F.col("g"), F.lit(1.0))), F.lit(1.084)) - 5.381) * 1.509
    risk = f * f * 10.0
    return [
        F.avg(F.when(f < 0, risk).otherwise(0.0)).alias("lbgi"),
        F.avg(F.when(f > 0, risk).otherwise(0.0)).alias("hbgi"),
    ]


def j_index_agg() -> Column:
    mean, sd = _mean_sd()
    return (F.pow(mean + sd, F.lit(2.0)) * 0.001).alias("j_index")


def gmi_agg() -> Column:
    return (F.avg("g") * 0.02392 + 3.31).alias("gmi")


def per_subject(series: DataFrame, aggs: list[Column]) -> DataFrame:
    return series.groupBy("subject_id").agg(*aggs)


def iqr(series: DataFrame) -> DataFrame:
    q = quantiles(series, ["subject_id"], "g", {"p25": 0.25, "p75": 0.75})
    return q.select("subject_id", (F.col("p75") - F.col("p25")).alias("iqr_glucose"))


def sampling_interval(placed: DataFrame) -> DataFrame:
    """Median positive gap in minutes between successive readings, 5 when there is none."""
    gap = (micros("ts") - micros("ts_prev")) / F.lit(6e7)
    gaps = placed.select("subject_id", gap.alias("gap")).where(F.col("gap") > 0)
    med = quantiles(gaps, ["subject_id"], "gap", {"interval_min": 0.5})
    return placed.select("subject_id").distinct().join(med, "subject_id", "left").select(
        "subject_id", F.coalesce("interval_min", F.lit(DEFAULT_GAP_MINUTES)).alias("interval_min")
    )


def mage(placed: DataFrame) -> DataFrame:
    """Mean swing between successive turning points, swings above one sd only."""
    g, before, after = F.col("g"), F.col("g_prev"), F.col("g_next")
    turning = placed.where(
        (F.col("pos") == 1) | (F.col("pos") == F.col("n")) | ((g - before) * (after - g) < 0)
    ).where(F.col("n") >= 3).select("subject_id", "pos", "g")
    swings = ordered(turning, ["subject_id"], ["pos"], lag={"g_turn": "g"}).select(
        "subject_id", "pos", F.abs(F.col("g") - F.col("g_turn")).alias("swing")
    ).where(F.col("swing").isNotNull())
    sd = per_subject(placed, moment_aggs()[1:2])
    kept = swings.join(sd, "subject_id").where(F.col("swing") > F.col("sd_glucose"))
    return sd.select("subject_id").join(
        kept.groupBy("subject_id").agg(F.avg("swing").alias("mage")), "subject_id", "left"
    ).select("subject_id", F.coalesce("mage", F.lit(0.0)).alias("mage"))


def lag_differences(placed: DataFrame, lags_hours: dict[str, float]) -> DataFrame:
    """g[i+k] - g[i] by position, k = half-even round of hours / sampling interval.

    Output: subject_id, lag (name), k, pos, diff.  The join key is (subject, position):
    evenly spread whatever the subject sizes are.
    """
    wanted = F.array(*[
        F.struct(F.lit(name).alias("lag"), F.lit(h * 60.0).alias("minutes"))
        for name, h in lags_hours.items()
    ])
    steps = sampling_interval(placed).withColumn("w", F.explode(wanted)).select(
        "subject_id", F.col("w.lag").alias("lag"),
        F.bround(F.col("w.minutes") / F.col("interval_min")).cast("bigint").alias("k"),
    ).where(F.col("k") >= 1)
    start = placed.select("subject_id", "pos", "g").join(steps, "subject_id").select(
        "subject_id", "lag", "k", "pos", F.col("g").alias("g0"), (F.col("pos") + F.col("k")).alias("at")
    )
    later = placed.select("subject_id", F.col("pos").alias("at"), F.col("g").alias("g1"))
    return start.join(later, ["subject_id", "at"]).select(
        "subject_id", "lag", "k", "pos", (F.col("g1") - F.col("g0")).alias("diff")
    )


def lag_metrics(placed: DataFrame, conga_hours: float = 1.0) -> DataFrame:
    """CONGA (sd of lagged differences) and MODD (mean absolute 24 h difference); NULL when too short."""
    diffs = lag_differences(placed, {"conga": conga_hours, "modd": 24.0})
    got = diffs.groupBy("subject_id").agg(
        F.stddev_samp(F.when(F.col("lag") == "conga", F.col("diff"))).alias("conga1"),
        F.avg(F.when(F.col("lag") == "modd", F.abs("diff"))).alias("modd"),
    )
    return placed.select("subject_id").distinct().join(got, "subject_id", "left")


def glucose_matrix(
    df: DataFrame, subject: str, value: str, ts: str | None, seq: str, *,
    conga_hours: float = 1.0, low: float = RANGE_LOW, high: float = RANGE_HIGH,
) -> DataFrame:
    """All metrics in contract order; subjects without a valid reading keep a row of NULLs."""
    placed = trace(clean_series(df, subject, value, ts, seq))
    simple = per_subject(
        placed, moment_aggs() + [j_index_agg(), gmi_agg()] + range_aggs(low, high) + risk_aggs()
    )
    everyone = df.select(F.col(subject).alias("subject_id")).where("subject_id is not null").distinct()
    out = everyone
    for part in (simple, iqr(placed), mage(placed), lag_metrics(placed, conga_hours)):
        out = out.join(part, "subject_id", "left")
    return out.select("subject_id", *FEATURES)
