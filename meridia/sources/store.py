"""The subject store: seven tables in one Spark database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meridia.operators.reshape import crosswalk_rows, ingest_panels, insert_missing
from meridia.schema import KEYS, STORE


class Store:
    """Create, drop and load the store; every load is idempotent."""

    def __init__(self, spark: SparkSession, database: str, location: str | None = None) -> None:
        self.spark, self.database, self.location = spark, database, location

    def name(self, table: str) -> str:
        return f"{self.database}.{table}"

    def create_all(self) -> None:
        where = f" LOCATION '{self.location}'" if self.location else ""
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.database}{where}")
        for table, schema in STORE.items():
            cols = ", ".join(f"{f.name} {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in schema)
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name(table)} ({cols}) USING parquet")

    def drop_all(self) -> None:
        for table in STORE:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name(table)}")

    def table(self, table: str) -> DataFrame:
        return self.spark.table(self.name(table))

    def append(self, table: str, df: DataFrame) -> int:
        """Add the rows whose key is not stored yet; returns how many."""
        cols = STORE[table].names
        new = df.selectExpr(*[f"CAST({c} AS {STORE[table][c].dataType.simpleString()}) AS {c}" if c in df.columns else f"CAST(NULL AS {STORE[table][c].dataType.simpleString()}) AS {c}" for c in cols])
        if table in KEYS:
            new = insert_missing(self.table(table), new.dropDuplicates(KEYS[table]), KEYS[table])
        before = self.table(table).count()
        new.write.mode("append").insertInto(self.name(table))
        return self.table(table).count() - before

    def rebuild(self, panels: dict[str, tuple[DataFrame, list[str]]], crosswalk: DataFrame | None = None,
                features: dict[str, DataFrame] | None = None) -> DataFrame:
        """Drop, create, ingest; then one row per table with its row count."""
        self.drop_all()
        self.create_all()
        subjects, cells = ingest_panels(panels)
        self.append("subjects", subjects)
        self.append("omics_features", cells)
        if crosswalk is not None:
            self.append("subject_crosswalk", crosswalk_rows(crosswalk))
        for table, long in (features or {}).items():
            self.append(table, long)
        rows = [(t, self.table(t).count()) for t in STORE]
        return self.spark.createDataFrame(rows, "table string, n bigint")

    def create_table_as(self, table: str, query: str) -> None:
        """CREATE OR REPLACE TABLE ... AS, as drop + CTAS for file tables."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name(table)}")
        self.spark.sql(f"CREATE TABLE {self.name(table)} USING parquet AS {query}")

    def create_view_as(self, view: str, query: str) -> None:
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {view} AS {query}")
