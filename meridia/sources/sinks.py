"""Writers: partitioned files, labelled CSV, idempotent tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

BUCKETS = 10


def _gathered(df: DataFrame, *keys: str) -> DataFrame:
    """Few files per key: adaptive execution gathers a key's rows and splits what is too large for one task."""
    return df.hint("rebalance", *[F.col(k) for k in keys])


def write_by_subject(df: DataFrame, path: str, key: str = "subject_id", buckets: int | None = None) -> None:
    """One folder per subject; with ``buckets``, one per hash bucket of subjects (for more subjects than folders will do)."""
    part = "bucket" if buckets else key
    out = df.withColumn("bucket", bucket_of(key, buckets)) if buckets else df
    _gathered(out, part).write.mode("overwrite").partitionBy(part).parquet(path)


def write_csv(df: DataFrame, path: str, label: str) -> None:
    """Header CSV with the label first."""
    df.select(label, *[c for c in df.columns if c != label]).write.mode("overwrite").csv(path, header=True)


def overwrite_table(df: DataFrame, table: str) -> int:
    """Replace a table and report how many rows went in, counted while writing."""
    seen = Observation("written")
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").saveAsTable(table)
    return int(seen.get["n"])


def bucket_of(key: str, buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_bucketed(df: DataFrame, path: str, key: str = "subject_id", cluster: str = "panel", buckets: int = BUCKETS) -> None:
    """Partitioned by key bucket, sorted by (cluster, key) inside files; NULL values dropped.

    A bucket is written by as many tasks as its size needs, so one hot subject does not fill one task.
    """
    rows = df.where(F.col("value").isNotNull()).withColumn("part_bucket", bucket_of(key, buckets))
    _gathered(rows, "part_bucket").sortWithinPartitions("part_bucket", cluster, key).write.mode(
        "overwrite").partitionBy("part_bucket").parquet(path)
