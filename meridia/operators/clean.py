"""Projection, filtering, missing values and quality checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.functions.columns import finite, ratio
from meridia.operators.ordered import quantiles

TARGET_TASKS = {"IRIS": "classification", "SSPG": "regression"}


def require_columns(df: DataFrame, needed: Iterable[str]) -> DataFrame:
    """ValueError naming what is missing and what was found."""
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df


def require_range(df: DataFrame, column: str, lo: float, hi: float) -> DataFrame:
    """ValueError when any value lies outside [lo, hi]; one min/max aggregate."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is not None and (low < lo or high > hi):
        raise ValueError(f"{column} must lie in [{lo}, {hi}]; found [{low}, {high}]")
    return df


def staging_distinct(df: DataFrame, key: str, upper: list[str], numeric: list[str]) -> DataFrame:
    return df.where(F.col(key).isNotNull()).select(
        F.col(key).cast("string").alias(key),
        *[F.upper(F.col(c).cast("string")).alias(c) for c in upper],
        *[F.col(c).try_cast("double").alias(c) for c in numeric],
    ).distinct()


def feature_matrix(df: DataFrame, key: str, target: str, features: list[str]) -> DataFrame:
    """Labelled rows only: label as INT (classes) or DOUBLE (regression), features as DOUBLE."""
    if target not in TARGET_TASKS:
        raise ValueError(f"unknown target {target!r}; choose from {sorted(TARGET_TASKS)}")
    require_columns(df, [key, target, *features])
    kind = "int" if TARGET_TASKS[target] == "classification" else "double"
    return df.where(F.col(target).isNotNull()).select(
        key, F.col(target).cast(kind).alias(target), *[F.col(f).cast("double").alias(f) for f in features]
    )


def add_ratio(df: DataFrame, num: str, den: str, name: str) -> DataFrame:
    """num/den, added only when both columns exist and no denominator in the table is 0."""
    if num not in df.columns or den not in df.columns:
        return df
    if df.agg(F.bool_or(F.col(den) == 0)).first()[0]:
        return df
    return df.withColumn(name, ratio(F.col(num), F.col(den)))


def attach_target(features: DataFrame, targets: DataFrame, key: str, target: str) -> DataFrame:
    return features.join(targets.select(key, target), key)


def subjects_in(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def join_key(col: str, prefix: str = "1636-") -> list[Column]:
    """'1636-69-000/Z00000' -> site '69-000', zcode 'Z00000'."""
    parts = F.split(F.replace(F.col(col), F.lit(prefix), F.lit("")), "/")
    return [F.element_at(parts, 1).alias("site_code"), F.try_element_at(parts, F.lit(2)).alias("zcode")]


OTHER = {"analyte": "subject_id", "subject_id": "analyte"}


def missing_by(cells: DataFrame, key: str) -> DataFrame:
    """Missing share of each ``key`` over the full grid: a cell that is absent is as missing as a NULL one."""
    other = cells.agg(F.count_distinct(OTHER[key])).scalar()
    return cells.groupBy(key).agg(F.count("value").alias("present")).select(
        key, (F.lit(1.0) - ratio(F.col("present"), other)).alias("missing_fraction"))


def missingness_profile(cells: DataFrame) -> DataFrame:
    parts = [
        missing_by(cells, k).select(F.lit(k).alias("kind"), F.col(k).cast("string").alias("name"), "missing_fraction")
        for k in ("analyte", "subject_id")
    ]
    return parts[0].unionByName(parts[1])


def missingness_summary(cells: DataFrame) -> DataFrame:
    """One row: totals of the full grid, how many analytes exceed 50 % and 20 %, and the spread over patients."""
    gone = F.col("missing_fraction")
    total = cells.agg(F.count_distinct("subject_id").alias("p"), F.count_distinct("analyte").alias("a"), F.count("value").alias("v"))
    over = missing_by(cells, "analyte").agg(F.struct(F.count_if(gone > 0.5).alias("half"), F.count_if(gone > 0.2).alias("fifth")))
    per = missing_by(cells, "subject_id")
    spread = per.agg(F.struct(
        F.count(F.lit(1)).alias("n_patients"), F.avg(gone).alias("mean"), F.stddev_samp(gone).alias("sd"),
        F.min(gone).alias("min"), F.max(gone).alias("max"), F.count_if(gone > 0.5).alias("patients_over_50")))
    mid = quantiles(per, [], "missing_fraction", {"p25": 0.25, "p50": 0.5, "p75": 0.75}).select(F.struct("p25", "p50", "p75"))
    row = total.select(
        (F.col("p") * F.col("a")).alias("n_cells"), (F.col("p") * F.col("a") - F.col("v")).alias("n_missing"),
        over.scalar().alias("over"), spread.scalar().alias("spread"), mid.scalar().alias("mid"))
    return row.select(
        "n_cells", "n_missing", F.col("over.half").alias("analytes_over_50"), F.col("over.fifth").alias("analytes_over_20"),
        "spread.*", "mid.*")


def worst_missing(cells: DataFrame, key: str, k: int = 5) -> DataFrame:
    return missing_by(cells, key).orderBy(F.desc("missing_fraction"), key).limit(k)


def drop_sparse(cells: DataFrame, max_missing: float = 0.5, by: str = "subject_id") -> DataFrame:
    """Keep the cells of patients (or analytes) with at most ``max_missing`` of them missing."""
    kept = missing_by(cells, by).where(F.col("missing_fraction") <= max_missing)
    return cells.join(kept.select(by), by, "left_semi")


def split_sheet(long: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """(labels, analyte cells) of an unpivoted sheet: row_label, column, value.

    Patient columns are ``Z`` followed by six upper-case letters or digits.
    """
    patients = long.where(F.col("column").rlike("^Z[A-Z0-9]{6}$"))
    labels = patients.where(F.col("row_label") == label).select(
        F.col("column").alias("subject_id"), F.col("value").alias("label")
    )
    cells = patients.where(F.col("row_label") != label).select(
        F.col("column").alias("subject_id"), F.col("row_label").alias("analyte"), "value"
    )
    return labels, cells


def medians(cells: DataFrame) -> DataFrame:
    return quantiles(cells, ["analyte"], "value", {"median": 0.5})


def impute(cells: DataFrame, fill: DataFrame | None = None) -> DataFrame:
    """The full grid of patients x analytes, NULL and absent cells filled with their analyte's median.

    Medians are learned here or supplied from training rows.  The grid is the result's size;
    it comes from the patients and the list of analytes.
    """
    fill = medians(cells) if fill is None else fill
    analytes = cells.agg(F.collect_set("analyte")).scalar()
    grid = cells.select("subject_id").distinct().select("subject_id", F.explode(analytes).alias("analyte"))
    return grid.join(cells, ["subject_id", "analyte"], "left").join(fill, "analyte", "left").select(
        "subject_id", "analyte", F.coalesce("value", "median").alias("value")
    )


def _qc_columns(columns: list[str]) -> tuple[list[str], list[str]]:
    r_cols = [c for c in columns if c.startswith("cor_r")]
    p_starts = ("cor_p", "adj.p", "LMM", "Inter")
    p_cols = [c for c in columns if "p" in c and c != "cor_char" and c.startswith(p_starts)]
    return r_cols, p_cols


def range_qc(df: DataFrame) -> DataFrame:
    """Missing values, correlations outside [-1,1], p-values outside [0,1], and whether all is well."""
    r_cols, p_cols = _qc_columns(df.columns)

    def count(exprs: list[Column]) -> Column:
        out = F.lit(0).cast("bigint")
        for e in exprs:
            out = out + F.count_if(e)
        return out

    def at(c: str) -> Column:
        return F.col(f"`{c}`")

    got = df.agg(
        count([at(c).isNull() for c in df.columns]).alias("missing"),
        count([(at(c) < -1) | (at(c) > 1) for c in r_cols]).alias("r_out_of_range"),
        count([(at(c) < 0) | (at(c) > 1) for c in p_cols]).alias("p_out_of_range"),
    )
    bad = F.col("missing") + F.col("r_out_of_range") + F.col("p_out_of_range")
    return got.withColumn("ok", bad == 0)


def dq_assertions(subjects: DataFrame, cells: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """One row: subjects without a label, negative feature values, crosswalk rows without a subject."""
    negative = cells.agg(F.count_if(F.col("value") < 0)).scalar()
    orphans = orphan_rows(crosswalk, subjects).agg(F.count(F.lit(1))).scalar()
    return subjects.agg(F.count_if(F.col("sspg").isNull()).alias("null_sspg")).select(
        "null_sspg", negative.alias("negative_values"), orphans.alias("orphan_crosswalk"))


def orphan_rows(crosswalk: DataFrame, subjects: DataFrame) -> DataFrame:
    ids = subjects.select(F.col("subject_id").alias("omics_subject_id"))
    return crosswalk.join(ids, "omics_subject_id", "left_anti")


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: finite in every row, and not constant.  One aggregate, then one row per column."""
    exprs = []
    for c in columns:
        exprs.append(F.struct(
            F.lit(c).alias("column"),
            F.bool_and(finite(F.col(c).cast("double")).isNotNull()).alias("all_finite"),
            F.coalesce(F.min(c) < F.max(c), F.lit(False)).alias("varying"),
        ).alias(c))
    row = df.agg(*exprs)
    return row.select(F.inline(F.array(*[F.col(c) for c in columns])))
