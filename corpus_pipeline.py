"""A corpus pipeline: toxic documents out, one of each group of copies, a mix of sources, token ids.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all that its predecessor
kept; all but the last return the columns of ``docs``, whatever their names.  An empty
table gives an empty table; texts of any length are taken whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.llm import byte_bpe, exact_dedup, mixing, near_dedup, toxicity
from meridia.llm.common import sweep
from meridia.session import durable, ship


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on the labelled ones among them, does not reject.

    Rows of one doc_id with equal texts share their verdict; NULL and empty texts hold
    nothing toxic; NULL ids are judged like any other.
    """
    ship(spark)
    model = toxicity.fit_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    bad = durable(toxicity.rejected(docs, model).distinct(), "rejected").select(F.col("doc_id").alias("b_id"), F.col("row").alias("b_row"))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("b_doc"), docs["doc_id"].cast("bigint").alias("d_id"),
        F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("d_row"))
    same = F.col("d_id").eqNullSafe(F.col("b_id")) & (F.col("d_row") == F.col("b_row"))
    return rows.join(bad, same, "left_anti").select("b_doc.*")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (NULL being empty) the one with the largest doc_id, NULL the smallest; one row of rows repeated under an id."""
    ship(spark)
    sweep(spark)
    return exact_dedup.keep_one(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the one with the smallest doc_id.

    NULL and empty texts have no copies; a NULL doc_id stays only where its group has no other.
    """
    ship(spark)
    sweep(spark)
    return near_dedup.keep_one(docs, shingle=5, threshold=0.8)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy the mix takes, in training order: 150 % of all words, no document more than twice.

    A NULL source is a source, the last; texts without words (NULL, empty) take no room.
    """
    ship(spark)
    sweep(spark)
    return mixing.mix(docs, weights=(3, 1, 2), share=1.5, cap=2.0)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), n_tokens, and digests of the ids and of the bytes they decode to.

    NULL and empty texts have no ids; repeated rows stay.
    """
    ship(spark)
    sweep(spark)
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = byte_bpe.decode(byte_bpe.encode(docs, ranks, pattern), ranks, pattern)
    return coded.select(
        "doc_id", "ids", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("byte_bpe", tokenized),
]

#: A trained model and tokenizer merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
