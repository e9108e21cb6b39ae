"""Wearable and circadian features, one row per subject.

Everything starts from the one-minute series: after that aggregate a subject
has at most 1440 rows a day whatever the raw volume was, so the per-subject
windows below have a calendar bound, and the hour grid one sixty times smaller.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions.columns import correlation, finite_or_zero, hour_of_day, micros, ratio
from meridia.operators.ordered import quantiles

# Fixed values of the feature definitions.
SEDENTARY_BELOW = 100.0
VIGOROUS_ABOVE = 800.0
NIGHT_ROWS = 30
MINUTES_PER_DAY = 1440
OMEGA = 2.0 * math.pi / 24.0
TINY = 1e-12
FEATURES = [
    "worn_minutes", "worn_days", "span_days", "coverage_fraction",
    "hr_mean", "hr_std", "skin_temp_mean", "accel_mean",
    "hr_mesor", "hr_amplitude", "hr_acrophase_h",
    "temp_mesor", "temp_amplitude", "temp_acrophase_h",
    "hr_is", "hr_iv", "accel_is", "accel_iv", "accel_ra",
    "resting_hr", "nightly_min_hr", "hr_dip", "hr_dip_frac",
    "mvpa_min_per_day", "sedentary_min_per_day", "sedentary_bout_mean_min",
    "activity_fragmentation",
    "hr_sdnn", "hr_rmssd", "hr_within_day_std", "hr_day_to_day_cv",
    "hr_profile_regularity",
]

S = "subject_id"


def resample_minute(readings: DataFrame, channels: list[str], required: str = "hr") -> DataFrame:
    """One-minute means per subject and channel; minutes without the required channel are dropped.

    Plain ``window`` aggregation: the same code runs on a stream under a watermark.
    """
    return (
        readings.groupBy(S, F.window("ts", "1 minute").alias("w"))
        .agg(*[F.avg(c).alias(c) for c in channels])
        .where(F.col(required).isNotNull())
        .select(S, F.col("w.start").alias("ts"), *channels)
    )


def hour_grid(minutes: DataFrame, channels: list[str]) -> DataFrame:
    """Hourly means on a gap-free grid from first to last hour; adds the hour's index from the first."""
    hour = F.date_trunc("hour", "ts")
    means = minutes.groupBy(S, hour.alias("hour")).agg(*[F.avg(c).alias(c) for c in channels])
    spine = means.groupBy(S).agg(F.min("hour").alias("lo"), F.max("hour").alias("hi")).select(
        S, F.posexplode(F.expr("sequence(lo, hi, interval 1 hour)")).alias("idx", "hour")
    )
    return spine.join(means, [S, "hour"], "left").select(S, "idx", "hour", *channels)


def coverage_aggs() -> list[Column]:
    worn = F.count("hr")
    span = (F.max(micros("ts")) - F.min(micros("ts"))) / F.lit(86400e6)
    return [
        worn.alias("worn_minutes"), (worn / F.lit(float(MINUTES_PER_DAY))).alias("worn_days"), span.alias("span_days"),
        (worn / (span * float(MINUTES_PER_DAY) + 1.0)).alias("coverage_fraction"),
    ]


def sensor_aggs() -> list[Column]:
    return [
        finite_or_zero(F.avg("hr")).alias("hr_mean"), finite_or_zero(F.stddev_samp("hr")).alias("hr_std"),
        finite_or_zero(F.avg("skin_temp")).alias("skin_temp_mean"), finite_or_zero(F.avg("accel")).alias("accel_mean"),
    ]


def activity_aggs() -> list[Column]:
    worn = F.count("hr") / F.lit(float(MINUTES_PER_DAY))
    days = F.when(worn > 0, worn).otherwise(1.0)
    return [
        (F.count_if(F.col("accel") > VIGOROUS_ABOVE) / days).alias("mvpa_min_per_day"),
        (F.count_if(F.col("accel") < SEDENTARY_BELOW) / days).alias("sedentary_min_per_day"),
    ]


def wear_coverage(minutes: DataFrame) -> DataFrame:
    return minutes.groupBy(S).agg(*coverage_aggs())


def sensor_means(minutes: DataFrame) -> DataFrame:
    return minutes.groupBy(S).agg(*sensor_aggs())


def activity_minutes(minutes: DataFrame) -> DataFrame:
    return minutes.groupBy(S).agg(*activity_aggs())


def cosinor_aggs(channel: str, prefix: str) -> list[Column]:
    """The sums a least-squares fit on [1, cos wt, sin wt] needs, rows without the channel left out."""
    y, w = F.col(channel), F.lit(OMEGA) * hour_of_day("ts")
    c, s = F.when(y.isNotNull(), F.cos(w)), F.when(y.isNotNull(), F.sin(w))
    sums = {
        "n": F.count(y), "my": F.avg(y), "mc": F.avg(c), "ms": F.avg(s), "vcc": F.var_pop(c), "vss": F.var_pop(s),
        "vcs": F.covar_pop(c, s), "vcy": F.covar_pop(c, y), "vsy": F.covar_pop(s, y),
    }
    return [e.alias(f"__{prefix}_{k}") for k, e in sums.items()]


def solve_cosinor(sums: DataFrame, prefix: str) -> DataFrame:
    """Adds mesor, amplitude and peak hour to the sums of :func:`cosinor_aggs`; minimum-norm where the
    times do not pin the curve.

    Times of day lie on the unit circle, so a singular system has at most two distinct
    times: the second and third branches are its minimum-norm solutions for two and one.
    Built in steps, so no step repeats a large expression.
    """
    def c(name: str) -> Column:
        return F.col(f"__{prefix}_{name}")

    def add(df: DataFrame, **exprs: Column) -> DataFrame:
        return df.withColumns({f"__{prefix}_{k}": e for k, e in exprs.items()})

    wide = c("vcc") >= c("vss")
    out = add(sums, det=c("vcc") * c("vss") - c("vcs") * c("vcs"), var=c("vcc") + c("vss"),
              a=F.when(wide, c("vcc")).otherwise(c("vcs")), b=F.when(wide, c("vcs")).otherwise(c("vss")))
    # direction of the line through the two times, slope along it, and the mean point across it
    out = add(out, size=F.hypot(c("a"), c("b")))
    out = add(out, u=F.try_divide(c("a"), c("size")), w=F.try_divide(c("b"), c("size")))
    out = add(out, k=F.try_divide(c("u") * c("vcy") + c("w") * c("vsy"), c("var")), q=c("u") * c("ms") - c("w") * c("mc"))
    out = add(out, t=(c("my") - c("k") * (c("u") * c("mc") + c("w") * c("ms"))) * c("q") / (c("q") * c("q") + 1.0))
    full, line, few = c("det") > TINY, c("var") > TINY, c("n") < 3

    def pick(direct: Column, on_line: Column, single: Column) -> Column:
        return F.when(few, 0.0).when(full, F.try_divide(direct, c("det"))).when(line, on_line).otherwise(single)

    out = add(out, bc=pick(c("vss") * c("vcy") - c("vcs") * c("vsy"), c("k") * c("u") - c("t") * c("w"), c("my") * c("mc") / 2.0),
              bs=pick(c("vcc") * c("vsy") - c("vcs") * c("vcy"), c("k") * c("w") + c("t") * c("u"), c("my") * c("ms") / 2.0))
    mesor = F.when(~few & ~line, c("my") / 2.0).otherwise(c("my") - c("bc") * c("mc") - c("bs") * c("ms"))
    out = add(out, angle=F.atan2(c("bs"), c("bc")))
    peak = F.when(c("angle") < 0, c("angle") + 2.0 * math.pi).otherwise(c("angle")) / F.lit(OMEGA)
    kept = [x for x in out.columns if not x.startswith(f"__{prefix}_")]
    return out.select(
        *kept, finite_or_zero(mesor).alias(f"{prefix}_mesor"), finite_or_zero(F.hypot(c("bc"), c("bs"))).alias(f"{prefix}_amplitude"),
        finite_or_zero(peak).alias(f"{prefix}_acrophase_h"))


def cosinor_fit(minutes: DataFrame, channel: str, prefix: str) -> DataFrame:
    return solve_cosinor(minutes.groupBy(S).agg(*cosinor_aggs(channel, prefix)), prefix)


def rhythm(grid: DataFrame, channels: dict[str, str], amplitude: str | None = None, most: int = 10, least: int = 5) -> DataFrame:
    """Interdaily stability and intradaily variability per channel (channel -> output prefix), from the hour grid.

    The bin is the position in the grid modulo 24, counted from the subject's first hour.
    With ``amplitude`` also (M - L) / (M + L) of that channel's largest ``most`` and
    smallest ``least`` profile bins.
    """
    w = Window.partitionBy(S).orderBy("idx")
    stepped = grid.select("*", *[(F.col(c) - F.lag(c).over(w)).alias(f"__d_{c}") for c in channels])
    base = stepped.groupBy(S).agg(*[a for c in channels for a in (
        F.count(c).alias(f"__n_{c}"), F.avg(c).alias(f"__x_{c}"), (F.var_pop(c) * F.count(c)).alias(f"__t_{c}"),
        F.sum(F.col(f"__d_{c}") * F.col(f"__d_{c}")).alias(f"__dd_{c}"), F.count(f"__d_{c}").alias(f"__nd_{c}"))])
    bins = grid.groupBy(S, F.pmod("idx", F.lit(24)).alias("bin")).agg(*[F.avg(c).alias(f"__m_{c}") for c in channels])
    aggs = [F.sum(F.pow(F.col(f"__m_{c}") - F.col(f"__x_{c}"), F.lit(2.0))).alias(f"__b_{c}") for c in channels]
    if amplitude:
        aggs.append(F.sort_array(F.collect_list(f"__m_{amplitude}")).alias("__p"))  # 24 values at most
    joined = bins.join(base, S).groupBy(S, *[c for c in base.columns if c != S]).agg(*aggs)
    out = []
    for c, prefix in channels.items():
        n, tss = F.col(f"__n_{c}"), F.col(f"__t_{c}")
        usable = (n >= 24) & (tss > 0)
        out.append(finite_or_zero(F.when(usable, ratio(n * F.col(f"__b_{c}"), tss * 24.0))).alias(f"{prefix}_is"))
        out.append(finite_or_zero(F.when(usable, ratio(n * F.col(f"__dd_{c}"), F.col(f"__nd_{c}") * tss))).alias(f"{prefix}_iv"))
    if amplitude:
        low, high = _mean(F.slice("__p", 1, least), least), _mean(F.slice("__p", -most, most), most)
        enough = (F.size("__p") >= most + least) & (high + low > 0)
        out.append(finite_or_zero(F.when(enough, ratio(high - low, high + low))).alias(f"{channels[amplitude]}_ra"))
    return joined.select(S, *out)


def _mean(values: Column, n: int) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / n


def relative_amplitude(grid: DataFrame, channel: str) -> DataFrame:
    return rhythm(grid, {channel: channel}, channel).select(S, f"{channel}_ra")


def resting_rate(minutes: DataFrame) -> DataFrame:
    q = quantiles(minutes, [S], "hr", {"resting_hr": 0.05})
    return minutes.select(S).distinct().join(q, S, "left").select(
        S, finite_or_zero(F.col("resting_hr")).alias("resting_hr")
    )


def rolling_mean(minutes: DataFrame, value: str, name: str, rows: int = NIGHT_ROWS, least: int | None = None) -> DataFrame:
    """Trailing mean over ``rows`` rows (not minutes), NULL below ``least`` valid values."""
    least = rows // 2 if least is None else least
    w = Window.partitionBy(S).orderBy("ts").rowsBetween(1 - rows, 0)
    return minutes.withColumn(name, F.when(F.count(value).over(w) >= least, F.avg(value).over(w)))


def day_table(minutes: DataFrame) -> DataFrame:
    """Per subject and day: sd and mean of heart rate, lowest rolling mean."""
    return rolling_mean(minutes, "hr", "roll").groupBy(S, F.to_date("ts").alias("day")).agg(
        F.stddev_samp("hr").alias("sd"), F.avg("hr").alias("m"), F.sum("hr").alias("total"), F.count("hr").alias("n"),
        F.min("roll").alias("low"))


def dip_aggs() -> list[Column]:
    """Nightly low and its distance from the mean, over :func:`day_table`."""
    mean = finite_or_zero(ratio(F.sum("total"), F.sum("n")))
    low = finite_or_zero(F.avg("low"))
    return [low.alias("nightly_min_hr"), (mean - low).alias("hr_dip"),
            F.when(mean > 0, ratio(mean - low, mean)).otherwise(0.0).alias("hr_dip_frac")]


def day_aggs() -> list[Column]:
    cv = F.when((F.count(F.lit(1)) > 1) & (F.avg("m") > 0), ratio(F.stddev_samp("m"), F.avg("m")))
    return [finite_or_zero(F.avg("sd")).alias("hr_within_day_std"), finite_or_zero(cv).alias("hr_day_to_day_cv")]


def nightly_dip(minutes: DataFrame) -> DataFrame:
    return day_table(minutes).groupBy(S).agg(*dip_aggs())


def day_variability(minutes: DataFrame) -> DataFrame:
    return day_table(minutes).groupBy(S).agg(*day_aggs())


def with_runs(minutes: DataFrame, flag: Column, name: str) -> DataFrame:
    """Marks the rows opening a run of true (``<name>_open``); NULL flags neither open nor end a run."""
    before = Window.partitionBy(S).orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    was = F.last(flag, ignorenulls=True).over(before)
    return minutes.withColumn(f"{name}_open", flag & ~F.coalesce(was, F.lit(False)))


def run_aggs(flag: Column, name: str) -> list[Column]:
    """Rows and runs of true, and the mean run length (rows / runs)."""
    n, k = F.count_if(flag), F.count_if(f"{name}_open")
    return [n.alias(f"{name}_rows"), k.alias(f"{name}_runs"), F.coalesce(ratio(n, k), F.lit(0.0)).alias(f"{name}_mean_run")]


def runs(minutes: DataFrame, flag: Column, name: str) -> DataFrame:
    return with_runs(minutes, flag, name).groupBy(S).agg(*run_aggs(flag, name))


def _still() -> Column:
    return F.col("accel") < SEDENTARY_BELOW


def _active() -> Column:
    return F.col("accel") >= SEDENTARY_BELOW


def bout_columns() -> list[Column]:
    return [
        F.col("still_mean_run").alias("sedentary_bout_mean_min"),
        finite_or_zero(ratio(F.col("active_runs"), F.col("active_rows"))).alias("activity_fragmentation"),
    ]


def activity_bouts(minutes: DataFrame) -> DataFrame:
    marked = with_runs(with_runs(minutes, _still(), "still"), _active(), "active")
    return marked.groupBy(S).agg(*run_aggs(_still(), "still"), *run_aggs(_active(), "active")).select(S, *bout_columns())


def with_steps(minutes: DataFrame) -> DataFrame:
    """Heart-rate change from the previous row where that is exactly 60 s earlier."""
    w = Window.partitionBy(S).orderBy("ts")
    minute = (micros("ts") - micros(F.lag("ts").over(w))) == 60_000_000
    return minutes.withColumn("hr_step", F.when(minute, F.col("hr") - F.lag("hr").over(w)))


def beat_aggs() -> list[Column]:
    d = F.col("hr_step")
    return [F.coalesce(F.sqrt(F.avg(d * d)), F.lit(0.0)).alias("hr_rmssd"), finite_or_zero(F.stddev_samp("hr")).alias("hr_sdnn")]


def beat_variability(minutes: DataFrame) -> DataFrame:
    return with_steps(minutes).groupBy(S).agg(*beat_aggs())


def profile_regularity(minutes: DataFrame) -> DataFrame:
    """Mean over days of the correlation of the day's hourly profile with the subject's overall one."""
    cells = minutes.where(F.col("hr").isNotNull()).groupBy(
        S, F.to_date("ts").alias("day"), F.hour("ts").alias("h")
    ).agg(F.avg("hr").alias("v"))
    overall = cells.groupBy(S, "h").agg(F.avg("v").alias("o"))
    varied = (F.count(F.lit(1)) >= 3) & (F.stddev_samp("v") > 0) & (F.stddev_samp("o") > 0)
    per_day = cells.join(overall, [S, "h"]).groupBy(S, "day").agg(
        F.when(varied, correlation("v", "o")).alias("c")
    )
    per_subject = per_day.groupBy(S).agg(
        F.when(F.count(F.lit(1)) >= 2, F.avg("c")).alias("c")
    )
    return minutes.select(S).distinct().join(per_subject, S, "left").select(
        S, finite_or_zero(F.col("c")).alias("hr_profile_regularity")
    )


def wearable_matrix(minutes: DataFrame) -> DataFrame:
    """All features in contract order from the one-minute series (store the series first).

    Row-order columns are added in one sort per subject and aggregated in one pass;
    days, the hour grid, the profile and the percentile are one pass each.
    """
    marked = with_steps(with_runs(with_runs(minutes, _still(), "still"), _active(), "active"))
    simple = marked.groupBy(S).agg(
        *coverage_aggs(), *sensor_aggs(), *activity_aggs(), *beat_aggs(), *run_aggs(_still(), "still"),
        *run_aggs(_active(), "active"), *cosinor_aggs("hr", "hr"), *cosinor_aggs("skin_temp", "temp"),
    ).select("*", *bout_columns())
    out = solve_cosinor(solve_cosinor(simple, "hr"), "temp")
    for block in (
        rhythm(hour_grid(minutes, ["hr", "accel"]), {"hr": "hr", "accel": "accel"}, "accel"), resting_rate(minutes),
        day_table(minutes).groupBy(S).agg(*dip_aggs(), *day_aggs()), profile_regularity(minutes),
    ):
        out = out.join(block, S, "left")
    return out.select(S, *FEATURES)


def wear_summary(minutes: DataFrame) -> DataFrame:
    n = F.count("hr")
    return minutes.groupBy(S).agg(
        n.alias("worn_minutes"), F.round(n / F.lit(float(MINUTES_PER_DAY)), 1).alias("worn_days")
    )


def circadian_profile(minutes: DataFrame, channel: str) -> DataFrame:
    """Mean and standard error by clock hour on a fixed 0..23 spine, with the pooled fitted curve."""
    by_hour = minutes.groupBy(F.hour("ts").alias("hour")).agg(
        F.avg(channel).alias("mean"), ratio(F.stddev_samp(channel), F.sqrt(F.count(channel))).alias("sem")
    )
    fit = cosinor_fit(minutes.withColumn(S, F.lit(0)), channel, "c")
    spine = minutes.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    curve = fit.first()  # one row of three numbers
    turn = F.lit(OMEGA) * (F.col("hour") - F.lit(curve["c_acrophase_h"]))
    return spine.join(by_hour, "hour", "left").select(
        "hour", "mean", "sem",
        (F.lit(curve["c_mesor"]) + F.lit(curve["c_amplitude"]) * F.cos(turn)).alias("fitted"),
    )
