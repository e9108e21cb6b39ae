import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meridia.operators import ranking as R
from meridia.operators.metrics import classification_metrics, regression_metrics
from meridia.operators.ordered import ordered, quantiles
from meridia.operators.relational import risk_tiers


@pytest.fixture(scope="module")
def hot_rows():
    """One key holds most rows; ties in the sort value."""
    rng = np.random.default_rng(3)
    key = np.where(rng.random(600) < 0.7, "hot", rng.choice(["a", "b", "c"], 600))
    return pd.DataFrame({"k": key, "v": rng.integers(0, 40, 600).astype(float), "id": np.arange(600)})


def test_positions_sums_and_neighbours(spark, hot_rows, group_mode):
    df = spark.createDataFrame(hot_rows).repartition(5)
    got = ordered(df, ["k"], ["v", "id"], pos="pos", sums={"run": F.col("v")}, totals=True,
                  lag={"before": "v"}, lead={"after": "v"}).toPandas().sort_values(["k", "v", "id"])
    want = hot_rows.sort_values(["k", "v", "id"])
    g = want.groupby("k")
    assert got["pos"].tolist() == (g.cumcount() + 1).tolist()
    assert got["run"].tolist() == g["v"].cumsum().tolist()
    assert got["run_total"].tolist() == g["v"].transform("sum").tolist()
    assert got["pos_total"].tolist() == g["v"].transform("size").tolist()
    pd.testing.assert_series_equal(got["before"].reset_index(drop=True), g["v"].shift(1).reset_index(drop=True), check_names=False)
    pd.testing.assert_series_equal(got["after"].reset_index(drop=True), g["v"].shift(-1).reset_index(drop=True), check_names=False)


def test_hot_key_is_cut_over_partitions(spark, hot_rows):
    from meridia.operators.ordered import PART, lay_out

    laid = lay_out(spark.createDataFrame(hot_rows), ["k"], ["v", "id"], parts=6)
    assert laid.where("k = 'hot'").select(PART).distinct().count() > 1


def test_global_order(spark, hot_rows, group_mode):
    got = ordered(spark.createDataFrame(hot_rows), [], ["v", "id"], pos="pos").toPandas().sort_values("pos")
    assert got["id"].tolist() == hot_rows.sort_values(["v", "id"])["id"].tolist()
    assert got["pos"].tolist() == list(range(1, 601))


def test_quantiles(spark, hot_rows, group_mode):
    got = quantiles(spark.createDataFrame(hot_rows), ["k"], "v", {"lo": 0.05, "mid": 0.5, "hi": 0.9}, n="n").toPandas()
    for row in got.itertuples():
        v = hot_rows.loc[hot_rows.k == row.k, "v"]
        np.testing.assert_allclose([row.lo, row.mid, row.hi], np.percentile(v, [5, 50, 90]))
        assert row.n == len(v)


def test_rank_within_keeps_ties(spark):
    rows = [("g", 5.0, i) for i in range(40)] + [("g", 4.0, 99)] + [("h", 3.0, 1), ("h", 2.0, 2), ("h", 2.0, 3), ("h", 1.0, 4), ("h", None, 5)]
    got = R.rank_within(spark.createDataFrame(rows, "g string, v double, id int"), "g", "v", 2).toPandas()
    assert len(got[got.g == "g"]) == 40 and set(got[got.g == "g"].rk) == {1}
    assert sorted(got[got.g == "h"].id) == [1, 2, 3]


def test_concentration_and_zero_total(spark, group_mode):
    df = spark.createDataFrame([("a", 8.0), ("b", 1.0), ("c", 0.5), ("d", 0.5)], "n string, v double")
    got = {r["threshold"]: r["n_features"] for r in R.concentration(df, "n", "v").collect()}
    assert got == {0.8: 1, 0.9: 2, 0.95: 3}
    with pytest.raises(ValueError):
        R.concentration(df.withColumn("v", F.lit(0.0)), "n", "v")


def test_densest_window_brute_force(spark, group_mode):
    rng = np.random.default_rng(5)
    at = np.sort(rng.integers(0, 20 * 86400, 80))
    pdf = pd.DataFrame({"subject_id": "s", "ts": pd.to_datetime(at, unit="s"), "seq": np.arange(80)})
    got = R.densest_window(spark.createDataFrame(pdf)).first()
    counts = [np.searchsorted(at, t + 60 * 3600, "left") - i for i, t in enumerate(at)]
    assert got["n_readings"] == max(counts)
    assert pd.Timestamp(got["start_ts"]).value // 10**9 == at[int(np.argmax(counts))]


def test_scores_match_formulas(spark, group_mode):
    rng = np.random.default_rng(0)
    y, p = rng.integers(0, 12, 80).astype(float), rng.integers(0, 12, 80).astype(float)
    got = regression_metrics(spark.createDataFrame(pd.DataFrame({"y": y, "p": p})), "y", "p").first()
    ry, rp = pd.Series(y).rank(), pd.Series(p).rank()
    assert got["R2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert got["Spearman"] == pytest.approx(np.corrcoef(ry, rp)[0, 1])
    b = (y > 6).astype(int)
    s = p / 12
    got = classification_metrics(spark.createDataFrame(pd.DataFrame({"y": b, "p": s})), "y", "p").first()
    pos, neg = s[b == 1], s[b == 0]
    wins = np.mean([(a > c) + 0.5 * (a == c) for a in pos for c in neg])
    assert got["AUROC"] == pytest.approx(wins)


def test_one_class_has_no_auroc(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.2)], "y int, p double")
    got = classification_metrics(df, "y", "p").first()
    assert got["AUROC"] is None and got["Accuracy"] == 0.5


def test_constant_prediction_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "y double, p double")
    got = regression_metrics(df, "y", "p").first()
    assert got["Pearson"] is None and got["Spearman"] is None


def test_tiers(spark):
    df = spark.createDataFrame([(float(i),) for i in range(9)], "v double")
    got = risk_tiers(df, "v").groupBy("tier").count().toPandas().set_index("tier")["count"]
    assert got.to_dict() == {"Low": 3, "Moderate": 3, "High": 3}
