import pandas as pd
import pytest
from pyspark.sql import functions as F

from meridia.operators import clean as K
from meridia.operators import relational as J
from meridia.operators import reshape as P
from meridia.schema import STORE
from meridia.session import scratch_path
from meridia.sources import readers as R
from meridia.sources import sinks as W
from meridia.sources.store import Store


@pytest.fixture
def panels(spark):
    s9 = spark.createDataFrame([("ZAAA111", "IR", 1.0, 2.0), ("ZBBB222", "IS", 3.0, None), ("ZCCC333", None, 5.0, 6.0)],
                               "subject_id string, iris string, ALKP double, ALT double")
    s8 = spark.createDataFrame([("ZAAA111", 120.0, 50.0, 100.0), ("ZDDD444", 80.0, 60.0, 200.0)],
                               "subject_id string, sspg double, HDL double, TGL double")
    return {"S9": (s9, ["ALKP", "ALT"]), "S8": (s8, ["HDL", "TGL"])}


def test_ingest_round_trip(spark, panels):
    store = Store(spark, "t_store", scratch_path(spark, "t"))
    links = spark.createDataFrame([("ZAAA111", "1636-69-001", "69-001", "nan"), ("ZBBB222", None, "69-002", "")],
                                  "omics_subject_id string, cgm_subject_id string, site_code string, wearable_subject_id string")
    counts = {r["table"]: r["n"] for r in store.rebuild(panels, links).collect()}
    assert set(counts) == set(STORE)
    assert (counts["subjects"], counts["omics_features"], counts["subject_crosswalk"]) == (4, 9, 2)
    subjects, cells = store.table("subjects"), store.table("omics_features")
    a = subjects.where("subject_id = 'ZAAA111'").first()
    assert (a["sspg"], a["iris"]) == (120.0, "IR")
    assert subjects.where("subject_id = 'ZCCC333'").first()["iris"] is None
    wide = P.panel_matrix(cells, subjects, "S9", "iris", ["ALKP", "ALT"])
    assert wide.columns == ["subject_id", "iris", "ALKP", "ALT"] and wide.count() == 3
    hit = J.overlap_cohort(store.table("subject_crosswalk"), subjects).collect()
    assert len(hit) == 1 and hit[0]["iris"] == "IR"
    assert store.append("omics_features", P.ingest_panels(panels)[1]) == 0  # insert-or-ignore
    assert store.table("subject_crosswalk").where("wearable_subject_id is not null").count() == 0
    store.drop_all()
    assert not spark.catalog.tableExists("t_store.subjects")


def test_duplicate_cell_is_an_error(spark):
    cells = spark.createDataFrame([("a", "S9", "x", 1.0), ("a", "S9", "x", 2.0)], "subject_id string, panel string, analyte string, value double")
    subs = spark.createDataFrame([("a", "IR")], "subject_id string, iris string")
    with pytest.raises(ValueError):
        P.panel_matrix(cells, subs, "S9", "iris", ["x"])
    assert P.panel_matrix(cells, subs, "S8", "iris", ["x"]).count() == 0


def test_labels_and_ratio(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, 4.0), ("b", None, 1.0, 2.0)], "id string, SSPG double, TGL double, HDL double")
    assert K.feature_matrix(df, "id", "SSPG", ["TGL"]).count() == 1
    with pytest.raises(ValueError):
        K.feature_matrix(df, "id", "other", ["TGL"])
    assert K.add_ratio(df, "TGL", "HDL", "r").where("id = 'a'").first()["r"] == 0.5
    assert "r" not in K.add_ratio(df.withColumn("HDL", F.lit(0.0)), "TGL", "HDL", "r").columns
    assert "r" not in K.add_ratio(df.drop("HDL"), "TGL", "HDL", "r").columns


def test_impute_with_given_medians(spark):
    cells = spark.createDataFrame([("p", "a", 1.0), ("q", "a", None), ("r", "a", 3.0)], "subject_id string, analyte string, value double")
    fill = spark.createDataFrame([("a", 10.0)], "analyte string, median double")
    assert sorted(r["value"] for r in K.impute(cells, fill).collect()) == [1.0, 3.0, 10.0]
    assert sorted(r["value"] for r in K.impute(cells).collect()) == [1.0, 2.0, 3.0]


def test_class_weights(spark):
    df = spark.createDataFrame([(i % 5,) for i in range(20)], "label int")
    assert all(abs(r["weight"] - 1) < 1e-12 for r in J.class_weights(df, "label", 5).collect())
    skewed = spark.createDataFrame([(0,)] * 9 + [(1,)], "label int")
    got = {r["label"]: r["weight"] for r in J.class_weights(skewed, "label", 3).collect()}
    assert got[2] == 0 and sum(got.values()) == pytest.approx(3) and got[1] == pytest.approx(9 * got[0])
    with pytest.raises(ValueError):
        J.class_weights(spark.createDataFrame([(9,)], "label int"), "label", 5)


def test_orient_keeps_first_duplicate(spark):
    sheet = spark.createDataFrame([("A", 1, "1.5", "bad", 9.0), ("A", 2, "7", "8", 9.0), ("B", 3, "2", "3", 9.0)],
                                  "`Unnamed: 0` string, n int, `69-000/Z00000` string, `690-001/Z00001` string, All double")
    got = P.orient(sheet, "Unnamed: 0", "n").toPandas().set_index(["zcode", "analyte"])["value"]
    assert got[("Z00000", "A")] == 1.5 and pd.isna(got[("Z00001", "A")]) and got[("Z00001", "B")] == 3.0 and len(got) == 4


def test_ranking_join_keeps_absent_consensus_null(spark):
    main = spark.createDataFrame([("a", 1), ("b", 2)], "analyte string, rank_main int")
    gain = spark.createDataFrame([("a", 1.0)], "analyte string, gain double")
    cons = spark.createDataFrame([("b", 0.5)], "analyte string, consensus_freq double")
    got = J.ranking_join(main, gain, cons).collect()
    assert got[0]["consensus_freq"] is None and got[1]["consensus_freq"] == 0.5


def test_readers_report_what_is_missing(spark):
    path = scratch_path(spark, "none")
    with pytest.raises(FileNotFoundError):
        R.read_keyed_csv(spark, path)
    with pytest.raises(FileNotFoundError):
        R.read_by_stem(spark, path)
    spark.createDataFrame([(1,)], "x int").write.csv(path, header=True)
    with pytest.raises(ValueError):
        R.read_keyed_csv(spark, path)
    with pytest.raises(KeyError):
        R.embeddings_split(spark.createDataFrame([("train", 1)], "split string, v int"), "test")


def test_bucketed_write_is_stable(spark):
    path = scratch_path(spark, "bucketed")
    rows = spark.createDataFrame([(f"s{i}", "p", "a", float(i) if i else None) for i in range(50)], "subject_id string, panel string, analyte string, value double")
    W.write_bucketed(rows, path)
    back = spark.read.parquet(path)
    assert back.count() == 49
    assert back.where(W.bucket_of("subject_id") != F.col("part_bucket")).count() == 0


def test_range_qc_and_profile(spark):
    df = spark.createDataFrame([(0.5, 0.1, 1.0), (1.5, -0.1, 1.0)], "cor_r double, cor_p double, c double")
    got = K.range_qc(df).first()
    assert (got["missing"], got["r_out_of_range"], got["p_out_of_range"], got["ok"]) == (0, 1, 1, False)
    prof = {r["column"]: r["varying"] for r in K.column_profile(df, ["cor_r", "c"]).collect()}
    assert prof == {"cor_r": True, "c": False}
    with pytest.raises(ValueError):
        K.require_range(df, "cor_r", 0.0, 1.0)


def test_parts_with_the_same_line_items_tie_and_rank_by_part(spark, tmp_path):
    from meridia.plans.store_queries import catalog

    lines = [(12345.67, 0.07), (901.1, 0.1), (50333.3, 0.03), (77.77, 0.09), (20101.01, 0.01), (8642.1, 0.06)]
    orders = {1: [1, 2, 4, 0, 5, 3], 2: [4, 5, 0, 1, 2, 3]}  # doubles added in the first order give less
    rows = [(part, 1.0, *lines[i]) for part, order in orders.items() for i in order]
    frame = spark.createDataFrame(rows, "l_partkey long, l_quantity double, l_extendedprice double, l_discount double")
    frame.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalog.queries["importance_rank"](spark, str(tmp_path)).collect()
    assert {r.analyte: r["rank"] for r in got} == {1: 1, 2: 2}


def test_param_summary_counts_each_value_once(spark):
    """Joining every row on its column's name put a whole column in one task."""
    values = [float(i % 12) for i in range(240)] + [100.5, -0.5, None]
    df = spark.createDataFrame([(v, "ab"[i % 2]) for i, v in enumerate(values)], "x double, s string")
    got = J.param_summary(df, ["x", "s"])
    rows = got.collect()
    assert [(r.median, r.min, r.max) for r in rows if r.column == "x"] == [(5.5, -0.5, 100.5)]
    assert {(r.value, r.n) for r in rows if r.column == "s"} == {("a", 122), ("b", 121)}
    assert all(r.n is None for r in rows if r.column == "x")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and "LeftAnti" not in plan
