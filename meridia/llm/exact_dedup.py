"""Exact dedup as a stateful stream.

The stream of (doc_id, digest, length) rows runs through a keyed aggregation whose
state lives in RocksDB and never expires.  Per digest it holds the number of rows,
the stable identifier (largest doc_id so far) and the content locator (length and
doc_id under which the text is found).  Rows are combined before they are
shuffled, so a text of a third of all rows reaches its key as one row per task.
Feeding more rows under the same checkpoint continues the same state.  Afterwards
every hit (a text whose digest another row had) is compared byte by byte with the
text its class points at; texts that differ under one digest form classes by text.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.llm.common import Stages, id_and_text
from meridia.session import durable, scratch_path

ROCKS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    # Thousands of small stores: no megabytes set aside for each one's logs, and none stays open after its commit.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.metricsEnabled": "false",
}


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]):
    """Session settings for the length of a block."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def feed(spark: SparkSession, folder: str, checkpoint: str) -> None:
    """Take every not yet seen file of (doc_id, digest, n_bytes) rows in ``folder`` into the state."""
    seen = spark.readStream.schema("doc_id bigint, digest binary, n_bytes bigint").parquet(folder)
    state = seen.groupBy("digest").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.min("n_bytes").alias("n_bytes"))
    with settings(spark, ROCKS):
        query = (
            state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()


def classes(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state as a table: digest, keep_id, group_size, n_bytes."""
    with settings(spark, ROCKS):
        state = spark.read.format("statestore").load(checkpoint)
        value = [f.name for f in state.schema["value"].dataType.fields]
        named = dict(zip(("keep_id", "group_size", "n_bytes"), value, strict=True))
        out = state.select(F.col("key.digest"), *[F.col("value")[v].alias(k) for k, v in named.items()])
        return durable(out, "classes")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per input row.

    Equal texts form a class; the largest doc_id of a class is kept.  NULL text is
    the empty text.  NULL is the smallest doc_id: it is kept only where a class has
    no other.  Rows repeated under one doc_id are one document: all are marked kept
    if it is, and each counts in group_size.  An empty table gives no rows; other
    columns are ignored.
    """
    spark = docs.sparkSession
    base = id_and_text(docs, id_col, text_col).withColumn("digest", digest_of(F.col("text")))
    stages = Stages(spark)
    folder, checkpoint = scratch_path(spark, "digests"), stages.path("state")
    base.select("doc_id", "digest", F.octet_length("text").cast("bigint").alias("n_bytes")).write.parquet(folder)
    ids = spark.read.schema("doc_id bigint, digest binary, n_bytes bigint").parquet(folder)
    if ids.isEmpty():
        found = spark.createDataFrame([], "digest binary, keep_id bigint, group_size bigint, n_bytes bigint")
    else:
        feed(spark, folder, checkpoint)
        found = classes(spark, checkpoint)
    ids = ids.select("doc_id", "digest").join(found.select("digest", "keep_id", "group_size"), "digest")
    ids = ids.withColumn("text_sha256", F.lower(F.hex("digest")))
    odd = differing(base, found, stages.keep)
    stages.drop()
    if not odd.isEmpty():  # one digest, several texts: by text, then
        again = (
            base.join(odd.select("digest").distinct(), "digest", "left_semi")
            .groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        )
        split = base.join(again, ["digest", "text"]).select("doc_id", "digest", "keep_id", "group_size")
        ids = ids.join(odd.select("digest").distinct(), "digest", "left_anti").unionByName(
            split.withColumn("text_sha256", F.lower(F.hex("digest"))))
    return ids.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def differing(base: DataFrame, found: DataFrame, store) -> DataFrame:
    """Rows (doc_id, digest) whose bytes are not those of the text their class points at."""
    hits = store(
        base.join(found.where(F.col("group_size") > 1).select("digest", "keep_id"), "digest")
        .select("doc_id", "digest", "text", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("is_kept")),
        "hits",
    )
    first = hits.where("is_kept").groupBy("digest").agg(F.min("text").alias("stored"))
    checked = hits.join(store(first, "stored"), "digest", "left")
    return durable(checked.where(~F.col("text").eqNullSafe(F.col("stored"))).select("doc_id", "digest"), "odd")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns; of rows repeated under one id the largest remaining columns."""
    kept = durable(
        exact_dedup(docs, id_col, text_col).where("kept").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("k_n"))
        .select(F.col("doc_id").alias("k_id"), F.col("text_sha256").alias("k_sha"), "k_n"), "keepers")
    rows = docs.select(F.struct(*docs.columns).alias("k_row"), docs[id_col].cast("bigint").alias("k_doc"),
                       F.sha2(F.coalesce(docs[text_col], F.lit("")), 256).alias("k_own"))
    same = F.col("k_doc").eqNullSafe(F.col("k_id")) & (F.col("k_own") == F.col("k_sha"))
    one = rows.join(kept.where("k_n = 1"), same, "left_semi").select("k_row.*")
    if kept.where("k_n > 1").isEmpty():
        return one
    repeated = rows.join(kept.where("k_n > 1"), same).groupBy("k_own", "k_doc").agg(F.max("k_row").alias("k_row"))
    return one.unionByName(repeated.select("k_row.*"))
