"""Joins and grouped aggregates over the subject store.

Sides of a join are left unhinted: Spark broadcasts one only when its measured
size is under the session's threshold, and splits skewed keys otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions.columns import clip, ratio
from meridia.operators.ordered import quantiles
from meridia.session import durable


def overlap_cohort(crosswalk: DataFrame, subjects: DataFrame) -> DataFrame:
    linked = crosswalk.where(F.col("cgm_subject_id").isNotNull())
    return linked.join(subjects, linked["omics_subject_id"] == subjects["subject_id"]).select(
        "omics_subject_id", "cgm_subject_id", "site_code", "iris", "sspg"
    )


def panel_agg(cells: DataFrame) -> DataFrame:
    return cells.groupBy("subject_id").agg(
        F.countDistinct("analyte").alias("n_analytes"), F.avg("value").alias("mean_value")
    )


def patient_multimodal(subjects: DataFrame, omics: DataFrame, cgm: DataFrame) -> DataFrame:
    """Subjects with both aggregates where present; each side has one row per subject already."""
    return subjects.join(omics, "subject_id", "left").join(
        cgm.withColumn("has_cgm", F.lit(True)), "subject_id", "left"
    ).withColumn("has_cgm", F.coalesce("has_cgm", F.lit(False)))


def subject_feature_counts(subjects: DataFrame, cells: DataFrame, k: int = 5) -> DataFrame:
    """Labelled subjects with most features; counted before the join."""
    counts = cells.groupBy("subject_id").agg(F.count("analyte").alias("n_features"))
    return subjects.where(F.col("sspg").isNotNull()).join(counts, "subject_id", "left").select(
        "subject_id", "sspg", F.coalesce("n_features", F.lit(0)).alias("n_features")
    ).orderBy(F.desc("n_features"), "subject_id").limit(k)


def fill_labels(first: DataFrame, second: DataFrame) -> DataFrame:
    """Label of the first source, else of the second; ``origin`` names which."""
    a = first.select("subject_id", F.col("label").alias("a"))
    b = second.select("subject_id", F.col("label").alias("b"))
    return a.join(b, "subject_id", "full").select(
        "subject_id", F.coalesce("a", "b").alias("label"),
        F.when(F.col("a").isNotNull(), "first").when(F.col("b").isNotNull(), "second").alias("origin"),
    ).where(F.col("label").isNotNull())


def label_fill_join(rows: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Matrix rows having any label, with the label and its origin."""
    return rows.join(fill_labels(first, second), "subject_id")


def site_code_link(series: DataFrame, links: DataFrame, labels: DataFrame) -> DataFrame:
    """Sensor id -> site code -> label; ids carry the ``1636-`` prefix."""
    ids = series.select("subject_id").distinct().withColumn(
        "site_code", F.replace("subject_id", F.lit("1636-"), F.lit(""))
    )
    return ids.join(links, "site_code").join(labels, "omics_subject_id").where(
        F.col("label").isNotNull() & ~F.isnan("label")
    ).select("subject_id", "site_code", "omics_subject_id", "label")


def key_intersection(left: DataFrame, right: DataFrame, key: str = "subject_id") -> DataFrame:
    return left.select(key).intersect(right.select(key))


def ranking_join(main: DataFrame, gain: DataFrame, consensus: DataFrame, top_n: int = 20) -> DataFrame:
    """Attribution ranking with gain and consensus next to it; what consensus lacks stays NULL."""
    return main.join(gain, "analyte", "left").join(
        consensus.select("analyte", "consensus_freq"), "analyte", "left"
    ).orderBy("rank_main", "analyte").limit(top_n)


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    share = ratio(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(1))))  # one row per class
    return counts.withColumn("pct", share * 100.0)


def class_weights(df: DataFrame, label: str, classes: int) -> DataFrame:
    """Inverse-frequency weights summing to the number of classes; an absent class weighs 0."""
    strange = df.where((F.col(label) < 0) | (F.col(label) >= classes)).limit(1)
    if not strange.isEmpty():
        raise ValueError(f"{label} must lie in [0, {classes})")
    counts = df.groupBy(F.col(label).cast("bigint").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    spine = df.sparkSession.range(classes).join(counts, "id", "left")
    inverse = F.coalesce(ratio(F.lit(1.0), F.col("n")), F.lit(0.0))
    everyone = Window.partitionBy(F.lit(1))  # one row per class
    return spine.select(
        F.col("id").alias("label"), F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce(ratio(inverse, F.sum(inverse).over(everyone)) * classes, F.lit(0.0)).alias("weight"),
    )


def param_summary(df: DataFrame, columns: list[str], many: int = 10) -> DataFrame:
    """Column profile: median, min and max of numeric columns with more than ``many`` distinct values,
    value counts of all others."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    counts = durable(text.unpivot([], columns, "column", "value").where(F.col("value").isNotNull()).groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n")), "counts")
    numeric = [c for c, t in df.dtypes if c in columns and t in ("double", "float", "int", "bigint")]
    distinct = counts.where(F.col("column").isin(numeric)).groupBy("column").agg(F.count(F.lit(1)).alias("d"))
    wide = [row["column"] for row in distinct.where(F.col("d") > many).collect()]  # names of columns
    is_wide = F.col("column").isin(wide) if wide else F.lit(False)
    # a number's text gives the number again, so the counted values serve the quantiles too
    numbers = counts.where(is_wide).select("column", F.col("value").cast("double").alias("x"), "n")
    spread = quantiles(numbers, ["column"], "x", {"median": 0.5, "min": 0.0, "max": 1.0}, weight=F.col("n"))
    return spread.unionByName(counts.where(~is_wide), allowMissingColumns=True)


def risk_tiers(df: DataFrame, value: str) -> DataFrame:
    """Low / Moderate / High by the exact tertiles of the whole column."""
    cut = quantiles(df.withColumn("one", F.lit(1)), ["one"], value, {"a": 1 / 3, "b": 2 / 3}).first()
    v = F.col(value)
    if cut is None:
        return df.withColumn("tier", F.lit(None).cast("string"))
    return df.withColumn(
        "tier", F.when(v.isNull(), None).when(v < cut["a"], "Low").when(v < cut["b"], "Moderate").otherwise("High")
    )


def risk_signal(value: Column, lo: Column, mid: Column, hi: Column, higher_is_risk: Column) -> Column:
    """Distance from the midpoint in half-ranges, positive = riskier, clipped to +-2.5."""
    half = F.greatest(mid - lo, hi - mid) + 1e-9
    raw = (value - mid) / half
    return clip(F.when(higher_is_risk, raw).otherwise(-raw), -2.5, 2.5)
