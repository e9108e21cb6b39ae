"""Schemas of the subject store."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, L = T.StringType(), T.DoubleType(), T.LongType()


def _table(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, t, null in fields])


_SERIES_FEATURES = _table(("subject_id", S, False), ("feature", S, False), ("value", D, True))

STORE = {
    "subjects": _table(
        ("subject_id", S, False), ("iris", S, True), ("sspg", D, True), ("fpg", D, True), ("clinical_class", S, True),
        ("gender", S, True), ("ethnicity", S, True), ("age", D, True), ("bmi", D, True)),
    "omics_features": _table(("subject_id", S, False), ("panel", S, False), ("analyte", S, False), ("value", D, True)),
    "wearable_features": _SERIES_FEATURES,
    "cgm_features": _SERIES_FEATURES,
    "subject_crosswalk": _table(
        ("omics_subject_id", S, True), ("cgm_subject_id", S, True), ("site_code", S, True), ("wearable_subject_id", S, True)),
    "predictions": _table(
        ("run_id", S, False), ("subject_id", S, False), ("target", S, False), ("model", S, False), ("y_true", D, True), ("y_pred", D, True)),
    "metrics": _table(("run_id", S, False), ("target", S, False), ("model", S, False), ("metric", S, False), ("value", D, True)),
}

# columns that identify one row of a store table
KEYS = {
    "subjects": ["subject_id"], "omics_features": ["subject_id", "panel", "analyte"],
    "wearable_features": ["subject_id", "feature"], "cgm_features": ["subject_id", "feature"],
}
