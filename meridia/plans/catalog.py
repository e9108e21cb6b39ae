"""A named set of queries, each with its SQL statement where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meridia.functions.columns import r

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} registered twice")
            self.queries[name] = fn
            if sql:
                self.sql[name] = sql
            return fn

        return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column for reporting."""
    return df.select(*[r(c, digits).alias(c) if t in ("double", "float") else c for c, t in df.dtypes])


def report_sql(ctes: str, body: str, doubles: str = "", digits: int = 6) -> str:
    """SQL twin of :func:`rounded`: ``doubles`` lists the columns to round."""
    swap = ", ".join(f"round({c}, {digits}) + 0.0::DOUBLE AS {c}" for c in doubles.split())
    head = f"WITH {ctes}\n" if ctes else ""
    star = f"* REPLACE ({swap})" if swap else "*"
    return f"{head}SELECT {star} FROM ({body})"
