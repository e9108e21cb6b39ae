import pytest

from meridia.operators import clean as K
from meridia.operators import highdim


def cells(spark):
    """Three patients, four analytes: (1, d), (2, c), (2, d), (3, b) are absent, (1, a) and (3, d) NULL."""
    rows = [(1, "a", None), (1, "b", 2.0), (1, "c", 5.0), (2, "a", 1.0), (2, "b", 4.0), (3, "a", 3.0), (3, "c", 7.0), (3, "d", None)]
    return spark.createDataFrame(rows, "subject_id long, analyte string, value double")


def test_absent_cells_are_missing(spark):
    got = {(r.kind, r.name): r.missing_fraction for r in K.missingness_profile(cells(spark)).collect()}
    assert got == pytest.approx({
        ("analyte", "a"): 1 / 3, ("analyte", "b"): 1 / 3, ("analyte", "c"): 1 / 3, ("analyte", "d"): 1.0,
        ("subject_id", "1"): 0.5, ("subject_id", "2"): 0.5, ("subject_id", "3"): 0.5})
    row = K.missingness_summary(cells(spark)).first()
    assert (row.n_cells, row.n_missing, row.analytes_over_50, row.analytes_over_20, row.n_patients, row.p50) == (12, 6, 1, 4, 3, 0.5)


def test_missing_as_in_wide_tables(spark):
    present = cells(spark).where("value IS NOT NULL")
    gone = {r.analyte: r.missing_fraction for r in K.missing_by(present, "analyte").collect()}
    assert {r.analyte: r.missing_fraction for r in highdim.prevalence(present, 3).collect()} == pytest.approx(gone)


def test_impute_fills_the_grid(spark):
    got = {(r.subject_id, r.analyte): r.value for r in K.impute(cells(spark)).collect()}
    assert len(got) == 12
    assert (got[1, "a"], got[2, "c"], got[3, "b"], got[1, "d"]) == (2.0, 6.0, 3.0, None)
    assert K.drop_sparse(cells(spark), 0.4).isEmpty() and K.drop_sparse(cells(spark), 0.5).count() == 8


def test_prune_keeps_the_earlier_column(spark):
    rows = [(i, a, float(v)) for i, v in enumerate([1, 5, 2, 8, 3, 9]) for a in ("a", "b")] + [(i, "c", float(i % 2)) for i in range(6)]
    df = spark.createDataFrame(rows, "subject_id long, analyte string, value double")
    order = spark.createDataFrame([("b", 0), ("a", 1), ("c", 2)], "analyte string, ordinal long")
    assert {r.analyte for r in highdim.correlation_prune(df, 0.95)[0].collect()} == {"a", "c"}
    assert {r.analyte for r in highdim.correlation_prune(df, 0.95, order)[0].collect()} == {"b", "c"}


def test_a_mean_of_just_50_is_missing_in_any_order(spark, tmp_path):
    from meridia.plans.tables import holed_cells

    hit, low = [72.55, 27.45, 27.45, 72.55, 27.45, 72.55, 27.45, 72.55, 27.45, 27.45, 72.55, 72.55], [49.99] * 9  # doubles added in this order stay below 600
    rows = [(8 * i, user, "view", v) for user, values in enumerate([hit, sorted(hit), low]) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double")
    frame.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.subject_id: r.value for r in holed_cells(spark, str(tmp_path)).collect()}
    assert got == {0: None, 1: None, 2: 49.99}
