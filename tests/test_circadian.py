import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meridia.operators import circadian as C
from meridia.session import durable


def minutes(spark, days=4, half=False, seed=0):
    ts = pd.date_range("2020-03-01", periods=days * 1440, freq="min")
    h = np.asarray(ts.hour + ts.minute / 60.0)
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({
        "subject_id": "Basis_001", "ts": ts, "hr": 65 + 12 * np.cos(2 * np.pi / 24 * (h - 16)) + rng.normal(0, 2, len(ts)),
        "accel": 30 + 900 * np.maximum(np.cos(2 * np.pi / 24 * (h - 14)), 0) + rng.normal(0, 5, len(ts)),
        "skin_temp": 92 - 2 * np.cos(2 * np.pi / 24 * (h - 4))})
    return pdf[h < 12] if half else pdf


@pytest.fixture(scope="module")
def built(spark):
    pdf = minutes(spark)
    df = durable(spark.createDataFrame(pdf))
    return pdf, df, C.wearable_matrix(df).toPandas().iloc[0]


def test_contract(built):
    row = built[2]
    assert list(row.index) == ["subject_id", *C.FEATURES] and len(C.FEATURES) == 32
    assert np.isfinite(row[C.FEATURES].astype(float)).all()


def test_cosinor_recovers_signal(built):
    row = built[2]
    assert row.hr_amplitude == pytest.approx(12, rel=0.15)
    assert row.hr_mesor == pytest.approx(65, abs=1)
    assert row.hr_acrophase_h == pytest.approx(16, abs=1)
    assert row.temp_acrophase_h == pytest.approx(16, abs=0.1)


def test_wear_and_rhythm(built):
    row = built[2]
    assert row.worn_minutes == 5760 and row.coverage_fraction == pytest.approx(1.0)
    assert 0 < row.accel_ra <= 1 and row.hr_is > 0.7 and row.hr_iv >= 0
    assert row.hr_dip > 0 and row.resting_hr < row.hr_mean and row.hr_profile_regularity > 0.9


def test_against_pandas(built):
    pdf, _, row = built
    s = pdf.set_index("ts")
    hourly = s["hr"].resample("1h").mean().to_numpy()
    prof = np.array([hourly[np.arange(len(hourly)) % 24 == b].mean() for b in range(24)])
    tss = ((hourly - hourly.mean()) ** 2).sum()
    assert row.hr_is == pytest.approx(len(hourly) * ((prof - hourly.mean()) ** 2).sum() / (24 * tss))
    assert row.hr_iv == pytest.approx(len(hourly) * (np.diff(hourly) ** 2).sum() / ((len(hourly) - 1) * tss))
    low = s["hr"].rolling(30, min_periods=15).mean().groupby(s.index.date).min().mean()
    assert row.nightly_min_hr == pytest.approx(low)
    assert row.hr_rmssd == pytest.approx(np.sqrt((s["hr"].diff().dropna() ** 2).mean()))
    still = (s["accel"] < 100).to_numpy()
    starts = np.sum(still & ~np.r_[False, still[:-1]])
    assert row.sedentary_bout_mean_min == pytest.approx(still.sum() / starts)


def test_half_days(spark):
    df = durable(spark.createDataFrame(minutes(spark, half=True)))
    assert 0.5 <= C.wear_coverage(df).first()["coverage_fraction"] < 0.65


@pytest.mark.parametrize("hours,values", [([6, 6, 6, 6], [1.0, 2.0, 3.0, 6.0]), ([6, 18, 6, 18], [1.0, 5.0, 3.0, 9.0]),
                                          ([3, 8, 3, 8], [1.0, 5.0, 3.0, 9.0]), ([1, 9, 17, 20], [4.0, 2.0, 7.0, 1.0]), ([5, 6], [2.0, 4.0])])
def test_cosinor_is_minimum_norm_least_squares(spark, hours, values):
    ts = [pd.Timestamp("2021-01-01") + pd.Timedelta(days=i, hours=h) for i, h in enumerate(hours)]
    df = spark.createDataFrame(pd.DataFrame({"subject_id": "s", "ts": ts, "hr": values}))
    got = C.cosinor_fit(df, "hr", "hr").first()
    if len(hours) < 3:
        assert (got["hr_mesor"], got["hr_amplitude"], got["hr_acrophase_h"]) == (np.mean(values), 0.0, 0.0)
        return
    w = 2 * np.pi / 24 * np.array(hours, float)
    b, *_ = np.linalg.lstsq(np.column_stack([np.ones(len(w)), np.cos(w), np.sin(w)]), np.array(values), rcond=1e-10)
    assert got["hr_mesor"] == pytest.approx(b[0])
    assert got["hr_amplitude"] == pytest.approx(np.hypot(b[1], b[2]))
    assert got["hr_acrophase_h"] == pytest.approx((np.arctan2(b[2], b[1]) % (2 * np.pi)) * 24 / (2 * np.pi))


def test_runs_ignore_missing_flags(spark):
    flags = [True, True, None, True, False, True, None, False, True]
    ts = pd.date_range("2020-01-01", periods=9, freq="min")
    df = spark.createDataFrame([("s", t.to_pydatetime(), f) for t, f in zip(ts, flags)], "subject_id string, ts timestamp, f boolean")
    got = C.runs(df, F.col("f"), "x").first()
    assert (got["x_rows"], got["x_runs"], got["x_mean_run"]) == (5, 3, 5 / 3)


def test_minutes_without_heart_rate_are_dropped(spark):
    rows = [("s", "2020-01-01 00:00:10", 60.0, 1.0), ("s", "2020-01-01 00:00:40", 70.0, None), ("s", "2020-01-01 00:01:10", None, 5.0)]
    df = spark.createDataFrame(rows, "subject_id string, ts string, hr double, accel double").withColumn("ts", F.to_timestamp("ts"))
    got = C.resample_minute(df, ["hr", "accel"]).collect()
    assert len(got) == 1 and got[0]["hr"] == 65.0 and got[0]["accel"] == 1.0
