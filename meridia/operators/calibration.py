"""Calibration of predictions: binned curves, Brier score, expected calibration error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.functions.columns import ratio


def _bin(p: Column, lo: float, hi: float, bins: int) -> Column:
    """Bin index by the computed edges lo + i*step, left-closed; values beyond the ends join the end bins."""
    step = (hi - lo) / bins
    edges = [lo + i * step for i in range(bins)]
    idx = F.lit(0)
    for i in range(1, bins):
        idx = F.when(p >= F.lit(edges[i]), i).otherwise(idx)
    return F.when(p.isNotNull(), idx)


def _curve(df: DataFrame, y: str, p: str, lo: float, hi: float, bins: int) -> DataFrame:
    return df.select(F.col(p).alias("p"), F.col(y).alias("y"), _bin(F.col(p), lo, hi, bins).alias("bin")).where(
        F.col("bin").isNotNull()
    ).groupBy("bin").agg(
        F.avg("p").alias("mean_predicted"), F.avg("y").alias("mean_observed"), F.count(F.lit(1)).alias("n")
    )


def regression_bins(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """Equal-width bins over the predicted range; empty bins are absent."""
    lo, hi = df.agg(F.min(p), F.max(p)).first()
    if lo is None:  # no predictions, no bins
        lo = hi = 0.0
    hi = hi if hi > lo else lo + 1e-9
    return _curve(df, y, p, lo, hi, bins)


def reliability_bins(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    return _curve(df, y, p, 0.0, 1.0, bins)


def brier_score(df: DataFrame, y: str, p: str) -> DataFrame:
    d = F.col(p) - F.col(y)
    return df.agg(F.avg(d * d).alias("brier"))


def expected_calibration_error(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    b = reliability_bins(df, y, p, bins)
    gap = F.abs(F.col("mean_predicted") - F.col("mean_observed"))
    return b.agg(ratio(F.sum(gap * F.col("n")), F.sum("n")).alias("ece"))
