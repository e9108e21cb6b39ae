"""Fitted scoring models as coefficient tables with a feature contract."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.operators import gram as G
from meridia.operators.models import RIDGE_ALPHAS, fold_grams, ridge_loo_errors, tree_model, with_features
from meridia.operators.ordered import quantiles
from meridia.session import durable


@dataclass
class ScoringModel:
    """Ordered features, intercept and coefficients: all a scorer needs."""

    name: str
    features: list[str]
    coef: list[float]

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(self.name, i, f, float(c)) for i, (f, c) in enumerate(zip(["(intercept)", *self.features], self.coef))]
        spark.createDataFrame(rows, "model string, pos int, feature string, coef double").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "ScoringModel":
        rows = spark.read.parquet(path).orderBy("pos").collect()
        if not rows:
            raise ValueError(f"no model stored at {path}")
        return ScoringModel(rows[0]["model"], [r["feature"] for r in rows[1:]], [r["coef"] for r in rows])

    def score(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """model, prediction and n_features per row; batch and streaming frames alike."""
        got = [c for c in df.columns if c not in keep]
        if got != self.features:
            raise ValueError(f"expected {len(self.features)} features {self.features}; got {len(got)} {got}")
        y = F.lit(float(self.coef[0]))
        for f, c in zip(self.features, self.coef[1:]):
            y = y + F.col(f).cast("double") * float(c)
        return df.select(*keep, F.lit(self.name).alias("model"), y.alias("prediction"),
                         F.lit(len(self.features)).alias("n_features"))


def fit_scoring_model(df: DataFrame, features: list[str], label: str, name: str = "ridge", alpha: float | None = None) -> ScoringModel:
    """Standardized ridge on every labelled row; alpha by leave-one-out error unless given."""
    rows = df.where(F.col(label).isNotNull()).select(
        F.array(*[F.col(f).cast("double") for f in features]).alias("x"), F.col(label).alias("y"), F.lit(0).alias("fold"))
    g = fold_grams(rows, "x", ["y"])
    if alpha is None:
        # no row carries fold -1, so its training set is every row
        errs = ridge_loo_errors(rows, "x", "y", "fold", g, folds=[-1])
        alpha = float(RIDGE_ALPHAS[int(np.argmin(errs[-1]))])
    coef = G.ridge(G.moments(g.total, g.p, g.centre), alpha)[:, 0]
    return ScoringModel(name, list(features), [float(c) for c in coef])


def holdout_residuals(predictions: DataFrame, key: str) -> DataFrame:
    return predictions.select(
        key, F.col("y_true").alias("measured"), F.col("y_pred").alias("predicted"),
        F.abs(F.col("y_true") - F.col("y_pred")).alias("abs_error"))


@dataclass
class ProfilePredictor:
    """Modality forests, a ridge meta-model, and the column statistics that turn signals into features."""

    bases: dict
    meta: np.ndarray
    mean: dict
    sd: dict
    sign: dict
    cuts: tuple[float, float]

    def score(self, signals: DataFrame, key: str) -> DataFrame:
        """Per row of modality signals: base scores, fused score and tier."""
        out = signals
        for m, model in self.bases.items():
            x = F.array(*[
                F.lit(float(a)) + F.col(m) * float(s * b) for a, b, s in zip(self.mean[m], self.sd[m], self.sign[m])])
            scored = model.transform(with_features(out.withColumn("__x", x), "__x"))
            out = scored.withColumn(f"{m}_score", F.col("prediction")).drop("features", "prediction", "__x")
        fused = F.lit(float(self.meta[0]))
        for m, c in zip(self.bases, self.meta[1:]):
            fused = fused + F.col(f"{m}_score") * float(c)
        tier = F.when(fused < self.cuts[0], "Low").when(fused < self.cuts[1], "Moderate").otherwise("High")
        return out.select(key, *[f"{m}_score" for m in self.bases], fused.alias("fused"), tier.alias("tier"))


def build_predictor(cohort: DataFrame, key: str, modalities: list[str], trees: int = 200, depth: int = 4) -> ProfilePredictor:
    """Fit on a cohort (key, y, one array per modality)."""
    mean, sd, sign, bases = {}, {}, {}, {}
    scored = cohort.select(key, "y", *modalities)
    for m in modalities:
        g = fold_grams(cohort.withColumn("fold", F.lit(0)), m, ["y"])
        mo = G.moments(g.total, g.p, g.centre)
        mean[m], sd[m] = mo.mean[: mo.p], mo.sd * np.sqrt(mo.n / (mo.n - 1))
        sign[m] = np.sign(mo.cov[: mo.p, mo.p])
        rows = with_features(scored.withColumnRenamed("y", "label"), m)
        bases[m] = tree_model("forest", numTrees=trees, maxDepth=depth).fit(rows.select("label", "features"))
        scored = bases[m].transform(rows).withColumnRenamed("label", "y").withColumn(f"{m}_score", F.col("prediction")).drop(
            "features", "prediction")
    scored = durable(scored.select(key, "y", *[f"{m}_score" for m in modalities]), "bases")
    meta = fit_scoring_model(scored, [f"{m}_score" for m in modalities], "y")
    fused = meta.score(scored.drop("y"), [key]).withColumn("one", F.lit(1))
    cut = quantiles(fused, ["one"], "prediction", {"a": 1 / 3, "b": 2 / 3}).first()
    return ProfilePredictor(bases, np.array(meta.coef), mean, sd, sign, (cut["a"], cut["b"]))

