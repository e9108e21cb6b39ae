"""Scores of predictions: one aggregate for moments, ranks by counted distinct values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.functions.columns import correlation, ratio
from meridia.operators.ordered import average_ranks, ordered
from meridia.session import durable


def _keyed(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    return (df, keys) if keys else (df.withColumn("__one", F.lit(1)), ["__one"])


def spearman(df: DataFrame, y: str, p: str, keys: list[str]) -> DataFrame:
    """Correlation of average ranks, on counted (y, p) pairs."""
    pairs = durable(df.groupBy(*keys, y, p).agg(F.count(F.lit(1)).alias("c")), "pairs")
    for col, rank in ((y, "ry"), (p, "rp")):
        pairs = pairs.join(average_ranks(pairs, keys, col, rank, F.col("c")).drop("n_tied"), [*keys, col])
    c, a, b = F.col("c"), F.col("ry"), F.col("rp")
    n = F.sum(c)
    cov = F.sum(c * a * b) - F.sum(c * a) * F.sum(c * b) / n
    va = F.sum(c * a * a) - F.sum(c * a) * F.sum(c * a) / n
    vb = F.sum(c * b * b) - F.sum(c * b) * F.sum(c * b) / n
    return pairs.groupBy(*keys).agg(ratio(cov, F.sqrt(va * vb)).alias("Spearman"))


def regression_metrics(df: DataFrame, y: str, p: str, keys: list[str] | None = None) -> DataFrame:
    """R2, MAE, RMSE, Pearson, Spearman, per key or over everything."""
    df, keys_ = _keyed(df, keys or [])
    res = F.col(y) - F.col(p)
    base = df.groupBy(*keys_).agg(
        (1.0 - ratio(F.avg(res * res), F.var_pop(y))).alias("R2"), F.avg(F.abs(res)).alias("MAE"),
        F.sqrt(F.avg(res * res)).alias("RMSE"),
        correlation(y, p).alias("Pearson"),
    )
    return base.join(spearman(df, y, p, keys_), keys_).select(
        *(keys or []), "R2", "MAE", "RMSE", "Pearson", "Spearman"
    )


def auroc(df: DataFrame, y: str, p: str, keys: list[str]) -> DataFrame:
    """Exact rank-sum area with tied scores at half weight; NULL with one class."""
    counted = df.groupBy(*keys, p).agg(
        F.count_if(F.col(y) == 1).alias("n1"), F.count_if(F.col(y) != 1).alias("n0")
    )
    placed = ordered(counted, keys, [p], sums={"below": F.col("n0")})
    wins = F.sum(F.col("n1") * (F.col("below") - F.col("n0") / 2.0))
    return placed.groupBy(*keys).agg(ratio(wins, F.sum("n1") * F.sum("n0")).alias("AUROC"))


def classification_metrics(df: DataFrame, y: str, p: str, keys: list[str] | None = None) -> DataFrame:
    """Accuracy, macro F1 and AUROC; threshold 0.5 for 0/1 labels, nearest integer otherwise."""
    df, keys_ = _keyed(df, keys or [])
    binary = df.agg(F.bool_and(F.col(y).isin(0, 1))).first()[0]
    score = F.col(p).cast("double")
    hard = (score >= 0.5).cast("int") if binary else F.rint(score).cast("int")
    cells = df.groupBy(*keys_, F.col(y).cast("int").alias("t"), hard.alias("h")).agg(F.count(F.lit(1)).alias("c"))
    acc = cells.groupBy(*keys_).agg(
        ratio(F.sum(F.when(F.col("t") == F.col("h"), F.col("c")).otherwise(0)), F.sum("c")).alias("Accuracy")
    )
    hit = F.when(F.col("t") == F.col("h"), F.col("c")).otherwise(0)
    sides = cells.select(*keys_, F.col("t").alias("cls"), "c", hit.alias("hit")).unionByName(
        cells.select(*keys_, F.col("h").alias("cls"), "c", F.lit(0).cast("bigint").alias("hit"))
    )
    per_class = sides.groupBy(*keys_, "cls").agg((2.0 * F.sum("hit") / F.sum("c")).alias("f1"))
    f1 = per_class.groupBy(*keys_).agg(F.avg("f1").alias("F1"))
    area = auroc(df, y, p, keys_) if binary else None
    if not keys:  # one row: the parts are scalars of it
        area = F.lit(None).cast("double") if area is None else area.select("AUROC").scalar()
        return acc.select("Accuracy", f1.select("F1").scalar().alias("F1"), area.alias("AUROC"))
    out = acc.join(f1, keys)
    out = out.withColumn("AUROC", F.lit(None).cast("double")) if area is None else out.join(area, keys)
    return out.select(*keys, "Accuracy", "F1", "AUROC")
