"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight schedule over training time (knots of a piecewise linear
curve).  Its integral is the source's share of the token demand, capped at a number
of passes over the source; what a cap cuts off is shared again by weight.  A source's
documents follow each other in the order of a hash, pass after pass; the words before
a copy are its place in the source's demand, and inverting the integrated schedule
turns that into a training position.  Documents are range-sorted by position.

A running sum within a source is taken in two levels: documents fall into hash
buckets (about the square root of the row count of them), so neither the sum inside
a bucket nor the sum over a source's buckets is large, whatever a source holds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.llm.common import partitions, word_count
from meridia.session import durable

Knots = list[tuple[float, float]]
#: Weight over training time for the 1st, 2nd, 3rd, ... source, repeating; only ratios over time matter.
SCHEDULES: list[Knots] = [[(0.0, 1.5), (1.0, 0.5)], [(0.0, 1.0), (1.0, 1.0)], [(0.0, 0.5), (0.5, 0.5), (1.0, 2.0)]]
WEIGHTS = (3.0, 1.0, 2.0)
ROW = ["s_null", "s", "bucket", "key", "doc_id", "row"]


def invert(schedule: Knots, demand: Column) -> Column:
    """Training time in 0..1 at which the given part (0..1) of the schedule's integral is reached."""
    pieces, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        area = (w0 + w1) / 2 * (t1 - t0)
        if area > 0:
            pieces.append((t0, w0, (w1 - w0) / (t1 - t0), total, area))
            total += area
    out = F.lit(1.0)
    for t0, w0, slope, before, area in reversed(pieces):
        due = F.greatest(demand * F.lit(total) - F.lit(before), F.lit(0.0))
        rise = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2.0 * slope) * due, F.lit(0.0)))
        at = F.when(due > 0, F.lit(t0) + F.lit(2.0) * due / (F.lit(w0) + rise)).otherwise(F.lit(t0))
        out = F.when(demand * F.lit(total) < F.lit(before + area), at).otherwise(out)
    return out


def targets(totals: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Adds slot, target, demand to one row per source (s_null, s, source_size).

    Sources in code-point order, NULL last, get the weights in turn.  Sorted by how
    soon their cap is reached, those before the water level are capped and the rest
    share what is left by weight.  The table has one row per source, so plain windows
    over it do.
    """
    every = Window.partitionBy(F.lit(0))
    by_name = every.orderBy("s_null", "s")
    slot = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))).cast("int")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("slot") + 1)
    named = totals.withColumn("slot", slot).withColumn("w", w).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    named = named.withColumn("full_at", F.col("most") / F.col("w"))
    by_level = every.orderBy("full_at", "s_null", "s")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        (F.col("demand") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    open_ = named.withColumn("demand", F.lit(float(share)) * F.sum("source_size").over(every)).withColumn("level", level)
    open_ = open_.withColumn("level", F.when(F.col("level") <= F.col("full_at"), F.col("level")))
    first = F.first("level", ignorenulls=True).over(
        by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    filled = open_.withColumn("water", first)
    target = F.least(F.col("most"), F.coalesce(F.col("water") * F.col("w"), F.col("most")))
    return filled.select("s_null", "s", "source_size", "slot", target.alias("target"), "demand")


def plan(
    docs: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, schedules: list[Knots] = SCHEDULES,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """doc_id, row, size, source_size, target, positions: one row per input row, range-sorted by first position.

    ``positions`` lists the training positions (in words) of the copies the mix takes,
    empty for a document it leaves out; a copy is taken if its middle lies before the
    source's target, so a source misses its target by half a document at most.  ``row``
    is a hash of the text.  Size counts words; NULL text has size 0.  The NULL source
    is a source of its own, after all others.  NULL and repeated doc_ids are ordinary
    rows, repeated rows follow each other in the source's order.  An empty table gives
    no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    sized = durable(docs.select(
        docs[id_col].cast("bigint").alias("doc_id"),
        F.xxhash64(docs[text_col]).alias("row"), word_count(docs[text_col]).alias("size"),
        docs[source_col].isNull().alias("s_null"), F.coalesce(docs[source_col].cast("string"), F.lit("")).alias("s"),
        F.md5(F.coalesce(docs[id_col].cast("string"), F.lit(""))).alias("key")), "sizes")
    digits = max(1, math.ceil(math.log(max(sized.count(), 1), 16) / 2))
    placed = sized.withColumn("bucket", F.substring("key", 1, digits))
    sums = placed.groupBy("s_null", "s", "bucket").agg(F.sum("size").alias("sum"))
    in_source = Window.partitionBy("s_null", "s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("s_null", "s", "bucket", F.coalesce(F.sum("sum").over(in_source), F.lit(0)).alias("start"))
    goals = targets(sized.groupBy("s_null", "s").agg(F.sum("size").alias("source_size")), weights, share, cap)
    offsets = starts.join(goals, ["s_null", "s"])
    in_bucket = Window.partitionBy("s_null", "s", "bucket").orderBy("key", "doc_id", "row")
    ran = F.coalesce(F.sum("size").over(in_bucket.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    full = placed.withColumn("ran", ran).join(offsets, ["s_null", "s", "bucket"])
    passes = F.sequence(F.lit(0), F.lit(math.ceil(cap) - 1))
    before = lambda k: k * F.col("source_size") + F.col("start") + F.col("ran")
    taken = F.filter(passes, lambda k: before(k) + F.col("size") / F.lit(2.0) < F.col("target"))

    def position(k: Column) -> Column:
        demand = F.least(before(k) / F.col("target"), F.lit(1.0))
        out = invert(schedules[0], demand)
        for slot in range(1, len(weights)):
            out = F.when(F.col("slot") == slot, invert(schedules[slot % len(schedules)], demand)).otherwise(out)
        return out * F.col("demand")

    out = durable(full.select(
        "doc_id", "row", "size", "source_size", "target", F.transform(taken, position).alias("positions")), "mix")
    return out.repartitionByRange(partitions(spark), F.get("positions", F.lit(0)), "doc_id")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` in training order, one for each copy taken, with their own columns only.

    Rows repeated under one doc_id and text are one document with all its copies; if they
    differ in other columns, the largest row stands for them.
    """
    planned = plan(docs, id_col=id_col, text_col=text_col, **how)
    planned = planned.where(F.size("positions") > 0).select(
        F.col("doc_id").alias("m_id"), F.col("row").alias("m_row"), F.explode("positions").alias("m_at"))
    same = planned.groupBy("m_id", "m_row").agg(F.array_sort(F.collect_list("m_at")).alias("m_ats"))
    counted = docs.select(F.struct(*docs.columns).alias("m_doc"), docs[id_col].cast("bigint").alias("d_id"), F.xxhash64(docs[text_col]).alias("d_row"))
    repeats = durable(
        counted.groupBy("d_id", "d_row").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeats")
    key = F.col("d_id").eqNullSafe(F.col("m_id")) & (F.col("d_row") == F.col("m_row"))
    if not repeats.isEmpty():
        one = repeats.select(F.col("d_id").alias("r_id"), F.col("d_row").alias("r_row"))
        hit = F.col("d_id").eqNullSafe(F.col("r_id")) & (F.col("d_row") == F.col("r_row"))
        merged = counted.join(one, hit, "left_semi").groupBy("d_id", "d_row").agg(F.max("m_doc").alias("m_doc"))
        counted = counted.join(one, hit, "left_anti").unionByName(merged.select("m_doc", "d_id", "d_row"))
    rows = counted.join(same, key).select("m_doc", F.explode("m_ats").alias("m_at"))
    spark = docs.sparkSession
    ordered = rows.repartitionByRange(partitions(spark), "m_at").sortWithinPartitions("m_at")
    return ordered.select("m_doc.*")
