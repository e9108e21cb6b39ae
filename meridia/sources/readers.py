"""File and table readers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.operators.clean import require_columns


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """TAB file with header, all columns text; a single column means it is comma-separated."""
    df = spark.read.csv(path, sep="\t", header=True, inferSchema=False)
    if len(df.columns) == 1:
        df = spark.read.csv(path, sep=",", header=True, inferSchema=False)
    return df.toDF(*[c.strip().strip('"').strip("'").strip() for c in df.columns])


def _found(read, path: str) -> DataFrame:
    try:
        return read(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            raise FileNotFoundError(f"nothing to read at {path}") from e
        raise


def read_keyed_csv(spark: SparkSession, path: str, key: str = "SubjectID") -> DataFrame:
    """CSV whose rows are keyed by ``key``; missing file or key column raise."""
    df = _found(lambda p: spark.read.csv(p, header=True, inferSchema=True), path)
    return require_columns(df, [key])


def read_by_stem(spark: SparkSession, folder: str) -> DataFrame:
    """Every ``*.parquet`` in a folder, subject_id = file stem; other files are ignored."""
    df = _found(lambda p: spark.read.option("pathGlobFilter", "*.parquet").parquet(p), folder)
    return df.withColumn("subject_id", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.parquet$", 1))


def read_members(spark: SparkSession, folder: str, pattern: str = r"^Basis_\d+\.csv$", parent: str = "Basis_Watch_Data") -> DataFrame:
    """Primary recordings only: file names matching ``pattern`` under ``parent`` of an extracted archive."""
    files = _found(lambda p: spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").csv(
        p, header=True, inferSchema=False), folder)
    name = F.col("_metadata.file_name")
    return files.where(name.rlike(pattern) & F.contains(F.col("_metadata.file_path"), F.lit(f"/{parent}/"))).withColumn(
        "subject_id", F.regexp_extract(name, r"^(.*)\.csv$", 1))


def scan_store(spark: SparkSession, tables: list[str]) -> dict[str, DataFrame]:
    """Every named store table that has rows."""
    found = {t: spark.table(t) for t in tables}
    return {t: df for t, df in found.items() if not df.isEmpty()}


def embeddings_split(df: DataFrame, split: str) -> DataFrame:
    """Vectors of one split; an absent split is a KeyError."""
    part = df.where(F.col("split") == split)
    if part.isEmpty():
        raise KeyError(f"no split {split!r} among the embeddings")
    return part
