"""Attribution of boosted trees, split gain, and accumulated local effects."""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.operators.models import tree_model, with_features
from meridia.operators.ordered import ordered, quantiles
from meridia.session import durable, scratch_path


def fit_boosted(df: DataFrame, x: str, y: str, **params):
    rows = with_features(df, x).select(F.col(y).cast("double").alias("label"), "features")
    return tree_model("boosted", **params).fit(rows)


def tree_tables(model, spark) -> list[dict]:
    """Node arrays of every tree, read back from the saved model (a few nodes per tree)."""
    path = scratch_path(spark, "boosted")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()
    out = []
    for t, weight in enumerate(model.treeWeights):
        mine = [n for n in nodes if n["treeID"] == t]
        out.append({
            "weight": float(weight),
            "feature": [n["split"]["featureIndex"] if n["leftChild"] >= 0 else -1 for n in mine],
            "cut": [n["split"]["leftCategoriesOrThreshold"][0] if n["leftChild"] >= 0 else 0.0 for n in mine],
            "left": [n["leftChild"] for n in mine], "right": [n["rightChild"] for n in mine],
            "value": [n["prediction"] for n in mine], "cover": [n["impurityStats"][0] for n in mine],
        })
    return out


def leaf_paths(tree: dict) -> list[tuple]:
    """Per leaf: value, the features split on above it, each one's share of cover, and the interval (low, high] leading there."""
    out = []

    def walk(node: int, held: dict[int, tuple[float, float, float]]) -> None:
        f = tree["feature"][node]
        if f < 0:
            parts = np.array([held[u] for u in held]).reshape(-1, 3).T
            out.append((tree["value"][node], list(held), *parts))
            return
        share, low, high = held.get(f, (1.0, -np.inf, np.inf))
        for child, bounds in ((tree["left"][node], (low, min(high, tree["cut"][node]))), (tree["right"][node], (max(low, tree["cut"][node]), high))):
            walk(child, {**held, f: (share * tree["cover"][child] / tree["cover"][node], *bounds)})

    walk(0, {})
    return out


def shapley_of_tree(tree: dict, x: np.ndarray, out: np.ndarray) -> float:
    """Adds the exact path-dependent Shapley values of one tree to ``out``; returns the tree's base value.

    A leaf counts with the product over its features of an indicator (the row lies in the
    feature's interval) where the feature is known, of the share of cover where it is not.
    The sums over subsets of equal size are the coefficients of the product of
    (share + indicator * t); a feature's own factor is divided out again.  The work is
    leaves x depth**2 a row, not subsets of the tree's features.
    """
    base = 0.0
    for value, features, share, low, high in tree.get("paths") or leaf_paths(tree):
        base += value * float(np.prod(share))
        d = len(features)
        inside = np.array([~(x[:, f] <= low[j]) & ((x[:, f] <= high[j]) | (high[j] == np.inf)) for j, f in enumerate(features)], float)
        product = np.zeros((d + 1, len(x)))
        product[0] = 1.0
        for j in range(d):
            product[1:j + 2] = product[1:j + 2] * share[j] + product[:j + 1] * inside[j]
            product[0] *= share[j]
        weight = [factorial(k) * factorial(d - k - 1) / factorial(d) for k in range(d)]
        for j, f in enumerate(features):
            known, total = product[d], np.zeros(len(x))
            for k in reversed(range(d)):
                total += weight[k] * np.where(inside[j] > 0, known, product[k] / share[j])
                known = product[k] - share[j] * known
            out[:, f] += tree["weight"] * value * (inside[j] - share[j]) * total
    return tree["weight"] * base if len(x) else 0.0


def tree_attribution(model, df: DataFrame, key: str, x: str) -> DataFrame:
    """key, base, prediction, phi (array): base + sum(phi) = prediction for every row."""
    trees = [{**t, "paths": leaf_paths(t)} for t in tree_tables(model, df.sparkSession)]

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            rows = np.stack(pdf["x"].to_numpy()).astype(float)
            phi = np.zeros_like(rows)
            base = sum(shapley_of_tree(t, rows, phi) for t in trees)
            yield pd.DataFrame({"k": pdf["k"], "base": base, "prediction": base + phi.sum(axis=1), "phi": list(phi)})

    kind = dict(df.dtypes)[key]
    out = df.select(F.col(key).alias("k"), F.col(x).alias("x")).mapInPandas(
        explain, f"k {kind}, base double, prediction double, phi array<double>")
    return out.withColumnRenamed("k", key)


def attribution_ranking(attributions: DataFrame, names: list[str]) -> DataFrame:
    """analyte, mean_abs: mean absolute attribution per feature."""
    labels = F.array(*[F.lit(n) for n in names])
    return attributions.select(F.posexplode("phi").alias("i", "v")).groupBy("i").agg(F.avg(F.abs("v")).alias("mean_abs")).select(
        F.element_at(labels, F.col("i") + 1).alias("analyte"), "mean_abs")


def gain_importance(model, names: list[str], spark) -> DataFrame:
    """analyte, gain: normalized total split gain."""
    got = model.featureImportances.toArray()
    return spark.createDataFrame([(n, float(g)) for n, g in zip(names, got)], "analyte string, gain double")


def ale_1d(model, df: DataFrame, x: str, feature: int, bins: int = 10) -> DataFrame:
    """edge, effect, n: centred accumulated local effect of one feature at its bin edges."""
    return ale_curves(model, df, x, [feature], bins).drop("feature")


def ale_curves(model, df: DataFrame, x: str, features: list[int], bins: int = 10) -> DataFrame:
    """feature (its index), edge, effect, n: centred accumulated local effects at the bin edges of every feature.

    Edges are the distinct quantiles of a feature, or all its values if fewer than three
    are distinct.  One pass scores each row twice per feature, at its bin's lower and upper edge.
    """
    spark = df.sparkSession
    wide = df.select(F.transform(F.col(x), lambda v: v.cast("double")).alias("x"))
    picked = F.array(*[F.struct(F.lit(f).alias("feature"), F.element_at("x", f + 1).alias("v")) for f in features])
    rows = wide.select("x", F.inline(picked))
    probs = {f"q{i}": i / bins for i in range(bins + 1)}
    edges = {r["feature"]: sorted({float(r[q]) for q in probs}) for r in quantiles(rows.drop("x"), ["feature"], "v", probs).collect()}
    cut = {f: e for f, e in edges.items() if len(e) >= 3}
    known = spark.createDataFrame(
        [(f, lo, hi) for f, e in cut.items() for lo, hi in zip(e, e[1:])], "feature int, lo double, hi double")
    # every distinct value is an edge; these bins stay distributed
    single = [f for f in features if f not in cut]
    distinct = rows.where(F.col("feature").isin(single) & F.col("v").isNotNull()).select("feature", "v").distinct()
    values = durable(ordered(distinct, ["feature"], ["v"], lag={"before": "v"}, lead={"after": "v"}), "values")
    # a value opens its bin, except the largest, which closes the last one
    last = F.col("after").isNull()
    by_value = values.where(~last | F.col("before").isNotNull()).select(
        "feature", "v", F.when(last, F.col("before")).otherwise(F.col("v")).alias("lo"), F.coalesce("after", "v").alias("hi"))
    table = F.array(*[F.array(*[F.lit(e) for e in cut.get(f, [])]).cast("array<double>") for f in range(max(features) + 1)])
    own = F.element_at(table, F.col("feature") + 1)
    inner = F.slice(own, F.lit(2), F.size(own) - 2)
    binned = rows.where(F.col("feature").isin(list(cut))).withColumn("edges", own).withColumn(
        "bin", F.size(F.filter(inner, lambda e: F.col("v") >= e))).select(
        "feature", "x", F.element_at("edges", F.col("bin") + 1).alias("lo"), F.element_at("edges", F.col("bin") + 2).alias("hi"))
    placed = binned.unionByName(rows.join(by_value, ["feature", "v"]).select("feature", "x", "lo", "hi"))
    ends = known.unionByName(by_value.groupBy("feature", "lo").agg(F.max("hi").alias("hi")))
    local = ends.join(_local_effects(model, placed), ["feature", "lo"], "left").na.fill({"d": 0.0, "n": 0})
    run = durable(ordered(local, ["feature"], ["lo"], sums={"upto": F.col("d")}), "ale")
    mid = F.col("upto") - F.col("d") / 2.0
    whole = run.groupBy("feature").agg(
        F.coalesce(F.try_divide(F.sum(mid * F.col("n")), F.sum("n")), F.lit(0.0)).alias("centre"),
        F.max("hi").alias("edge"), F.max_by("upto", "lo").alias("e"))
    opened = run.join(whole.select("feature", "centre"), "feature").select(
        "feature", F.col("lo").alias("edge"), (F.col("upto") - F.col("d") - F.col("centre")).alias("effect"), "n")
    closing = whole.select("feature", "edge", (F.col("e") - F.col("centre")).alias("effect"), F.lit(0).cast("bigint").alias("n"))
    # a constant feature moves nothing
    flat = values.where(F.col("before").isNull() & F.col("after").isNull()).select(
        "feature", F.col("v").alias("edge"), F.lit(0.0).alias("effect"), F.lit(0).cast("bigint").alias("n"))
    return opened.unionByName(closing).unionByName(flat)


def _local_effects(model, placed: DataFrame) -> DataFrame:
    """Mean prediction change from lower (side 0) to upper edge (side 1), and rows, per feature and bin."""
    sided = placed.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    edge = F.when(F.col("side") == 1, F.col("hi")).otherwise(F.col("lo"))
    moved = F.transform("x", lambda v, i: F.when(i == F.col("feature"), edge).otherwise(v))
    scored = model.transform(sided.select("feature", "lo", "side", array_to_vector(moved).alias("features")))
    sign = F.when(F.col("side") == 1, F.col("prediction")).otherwise(-F.col("prediction"))
    return scored.groupBy("feature", "lo").agg((F.avg(sign) * 2.0).alias("d"), F.count_if(F.col("side") == 1).alias("n"))
