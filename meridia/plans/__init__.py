"""Registered queries, grouped by topic."""

from meridia.plans import (
    advanced_queries, cleaning_queries, glucose_queries, jobs, model_queries, source_queries, store_queries,
    wearable_queries,
)

ALL = [m.catalog for m in (
    source_queries, cleaning_queries, store_queries, glucose_queries, wearable_queries, model_queries, advanced_queries, jobs,
)]
flagship = glucose_queries.glucose_matrix
