"""Wide and long forms, panel ingest and pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.functions.columns import finite
from meridia.operators.clean import duplicate_keys


def melt(df: DataFrame, key: str, columns: list[str], variable: str = "feature") -> DataFrame:
    """Wide to long, missing values dropped."""
    wide = df.select(key, *[finite(F.col(c).cast("double")).alias(c) for c in columns])
    return wide.unpivot([key], columns, variable, "value").where(F.col("value").isNotNull())


def subjects_of(panels: list[DataFrame]) -> DataFrame:
    """One row per subject with the labels found in any panel (sspg, iris)."""
    merged = None
    for p in panels:
        sspg = F.col("sspg") if "sspg" in p.columns else F.lit(None).cast("double")
        iris = F.col("iris") if "iris" in p.columns else F.lit(None).cast("string")
        part = p.select("subject_id", sspg.alias("sspg"), iris.alias("iris"))
        merged = part if merged is None else merged.unionByName(part)
    # max skips NULL, so a label in either panel wins over its absence in the other
    return merged.groupBy("subject_id").agg(F.max("sspg").alias("sspg"), F.max("iris").alias("iris"))


def insert_missing(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not stored yet (insert-or-ignore)."""
    return new.join(existing.select(*key), key, "left_anti")


def ingest_panels(panels: dict[str, tuple[DataFrame, list[str]]]) -> tuple[DataFrame, DataFrame]:
    """(subjects, long cells) of named panels: (frame with subject_id and labels, analyte columns)."""
    subjects = subjects_of([df for df, _ in panels.values()])
    cells = None
    for panel, (df, analytes) in panels.items():
        part = melt(df, "subject_id", analytes, "analyte").select(
            "subject_id", F.lit(panel).alias("panel"), "analyte", "value"
        )
        cells = part if cells is None else cells.unionByName(part)
    return subjects, cells


def crosswalk_rows(df: DataFrame) -> DataFrame:
    """The four link columns; the text 'nan' and blanks become NULL."""
    names = ["omics_subject_id", "cgm_subject_id", "site_code", "wearable_subject_id"]
    clean = [F.nullif(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("nan")) for c in names]
    return df.select(*[c.alias(n) for c, n in zip(clean, names)])


def panel_matrix(
    cells: DataFrame, subjects: DataFrame, panel: str, label: str, analytes: list[str], check: bool = True
) -> DataFrame:
    """One panel as a wide matrix, label first; a repeated (subject, analyte) cell is an error."""
    mine = cells.where(F.col("panel") == panel)
    if check and not duplicate_keys(mine, ["subject_id", "analyte"]).isEmpty():
        raise ValueError(f"panel {panel!r} repeats a (subject, analyte) cell")
    wide = mine.groupBy("subject_id").pivot("analyte", analytes).agg(F.first("value"))
    return wide.join(subjects.select("subject_id", label), "subject_id").select("subject_id", label, *analytes)


def feature_wide(long: DataFrame, features: list[str], ids: DataFrame | None = None) -> DataFrame:
    kept = long if ids is None else long.join(ids.select("subject_id"), "subject_id", "left_semi")
    return kept.groupBy("subject_id").pivot("feature", features).agg(F.first("value"))


def topk_by_distinct(cells: DataFrame, k: int = 8) -> DataFrame:
    return cells.groupBy("analyte").agg(F.countDistinct("subject_id").alias("n_subjects")).orderBy(
        F.desc("n_subjects"), "analyte"
    ).limit(k)


def pivot_topk(cells: DataFrame, k: int = 8) -> DataFrame:
    """Wide mean table of the k best-covered analytes; the k names are the only driver read."""
    names = [row["analyte"] for row in topk_by_distinct(cells, k).collect()]
    return cells.groupBy("subject_id").pivot("analyte", names).agg(F.avg("value"))


def conditional_pivot(long: DataFrame, picks: dict[str, str]) -> DataFrame:
    return long.groupBy("subject_id").agg(*[
        F.max(F.when(F.col("feature") == feature, F.col("value"))).alias(name) for feature, name in picks.items()
    ])


def orient(sheet: DataFrame, analyte: str, ordinal: str) -> DataFrame:
    """Analytes x patients sheet to long patient cells.

    Patient columns contain ``NN-NNN`` (two or three digits, then three); other
    columns are ignored.  Repeated analyte names keep their first row.
    """
    import re

    patients = [c for c in sheet.columns if re.search(r"\d{2,3}-\d{3}", c)]
    first = sheet.groupBy(analyte).agg(F.min(ordinal).alias(ordinal))
    kept = sheet.join(first, [analyte, ordinal], "left_semi")
    text = kept.select(F.col(analyte).alias("analyte"), *[F.col(f"`{c}`").cast("string").alias(c) for c in patients])
    long = text.unpivot(["analyte"], [F.col(f"`{c}`") for c in patients], "patient", "value")
    return long.select(
        F.substring_index("patient", "/", 1).alias("site_code"),
        F.when(F.contains("patient", F.lit("/")), F.substring_index("patient", "/", -1)).alias("zcode"),
        "analyte", finite(F.col("value").try_cast("double")).alias("value"),
    )


def concat_blocks(blocks: list[DataFrame], key: str = "subject_id") -> DataFrame:
    out = blocks[0]
    for b in blocks[1:]:
        out = out.join(b, key)
    return out


def union_reports(sections: dict[str, DataFrame]) -> DataFrame:
    """Stack report tables with different columns under a ``section`` tag."""
    out = None
    for name, df in sections.items():
        part = df.select(F.lit(name).alias("section"), "*")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
