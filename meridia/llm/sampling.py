"""Bounded samples of labelled rows, for fitting classifiers on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAIN = 1 << 30


def stratified(rows: DataFrame, label: str, bound: int, keys: list[str]) -> DataFrame:
    """About ``bound`` rows at most, as evenly over the labels as they allow, with ``weight`` = rows one stands for.

    Chosen by a hash of ``keys``, so a rerun takes the same rows; a label with few rows
    is taken whole.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    each = bound / max(len(counts), 1)
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, each / n))).otherwise(share)
    at = F.pmod(F.xxhash64(*keys, F.lit(77)), F.lit(GRAIN)) / F.lit(float(GRAIN))
    return rows.where(at < share).withColumn("weight", F.lit(1.0) / share)
