"""Row-ordered work per key, safe when one key holds most rows.

Rows are range-partitioned on (key, order columns), so Spark's sampling cuts a hot
key across as many partitions as it needs and keeps small keys together.  That
layout is written once with its partition number; windows then run on (key,
partition) and only the *seams* (one row per partition and key that continues in
another partition, so at most two per partition) are combined across partitions.
There is no other path: rows of any number are treated alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.session import durable

PART = "__part"


def lay_out(df: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """Range-partition on keys + order (ascending, NULL first) and store it with its partition number."""
    cols = [F.col(c) for c in [*keys, *order]]
    ranged = df.repartitionByRange(parts, *cols) if parts else df.repartitionByRange(*cols)
    return durable(ranged.withColumn(PART, F.spark_partition_id()), "layout")


def ordered(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    *,
    sums: dict[str, Column] | None = None,
    totals: bool = False,
    lag: dict[str, str] | None = None,
    lead: dict[str, str] | None = None,
    pos: str | None = None,
    parts: int | None = None,
    laid: bool = False,
) -> DataFrame:
    """Running sums, positions and neighbours in (keys, order).

    ``sums``    name -> expression: inclusive running sum under that name;
                with ``totals`` also the whole key's sum as ``<name>_total``.
    ``pos``     1-based row position inside the key.
    ``lag`` / ``lead``  new name -> column: the value one row before / after.
    ``laid``    the input already comes from :func:`lay_out` on the same columns.
    ``order`` must be unique inside a key for repeatable results.
    """
    sums = dict(sums or {})
    if pos:
        sums[pos] = F.lit(1).cast("bigint")
    lag, lead = dict(lag or {}), dict(lead or {})
    if not keys:
        df, keys = df.withColumn("__all", F.lit(0)), ["__all"]
    base = df if laid else lay_out(df, keys, order, parts)
    where = F.struct(*order) if len(order) > 1 else F.struct(F.col(order[0]), F.lit(0).alias("__z"))
    near = sorted(set(lag.values()) | set(lead.values()))

    # one row per (key, partition): sums and edge values
    aggs = [F.sum(e).alias(f"__s_{n}") for n, e in sums.items()]
    if lag:
        aggs.append(F.max_by(F.struct(*near), where).alias("__last"))
    if lead:
        aggs.append(F.min_by(F.struct(*near), where).alias("__first"))
    aggs.append(F.count(F.lit(1)).alias("__n"))
    edge = base.groupBy(*keys, PART).agg(*aggs)
    by_part = Window.partitionBy(*keys).orderBy(PART)
    before = by_part.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    picks = [F.col(k).alias(f"__k_{k}") for k in keys] + [F.col(PART).alias("__p")]
    for n in sums:
        picks.append(F.sum(f"__s_{n}").over(before).alias(f"__o_{n}"))
        if totals:
            picks.append(F.sum(f"__s_{n}").over(whole).alias(f"__t_{n}"))
    if lag:
        picks.append(F.lag("__last").over(by_part).alias("__prev"))
    if lead:
        picks.append(F.lead("__first").over(by_part).alias("__next"))
    picks.append(F.count(F.lit(1)).over(whole).alias("__pieces"))
    # at most two rows per partition survive: the key entering it and the key leaving it
    seams = edge.select(*picks).where(F.col("__pieces") > 1).drop("__pieces")

    joined = base.join(
        seams,
        [base[k] == seams[f"__k_{k}"] for k in keys] + [base[PART] == seams["__p"]],
        "left",
    )
    local = Window.partitionBy(*keys, PART).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    here = Window.partitionBy(*keys, PART)
    out = [F.col(c) for c in base.columns if c not in ("__all",)]
    for n, e in sums.items():
        out.append((F.sum(e).over(upto) + F.coalesce(F.col(f"__o_{n}"), F.lit(0))).alias(n))
        if totals:
            out.append(F.coalesce(F.col(f"__t_{n}"), F.sum(e).over(here)).alias(f"{n}_total"))
    packed = F.struct(*near) if near else None
    if lag:
        got = F.coalesce(F.lag(packed).over(local), F.col("__prev"))
        out += [got[c].alias(n) for n, c in lag.items()]
    if lead:
        got = F.coalesce(F.lead(packed).over(local), F.col("__next"))
        out += [got[c].alias(n) for n, c in lead.items()]
    result = joined.select(*out)
    return result if laid else result.drop(PART)


def quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], n: str | None = None, weight: Column | None = None
) -> DataFrame:
    """Exact linear-interpolated quantiles per key, NULL values skipped.  ``weight`` is the number of rows a row stands for.

    Equal values are counted before the shuffle and located by running counts, so
    neither a hot key nor a hot value lands in one task.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        (F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("__c")
    )
    placed = ordered(counted, keys, [value], sums={"__cum": F.col("__c")}, totals=True)
    v, hi_rank, lo_rank = F.col(value).cast("double"), F.col("__cum"), F.col("__cum") - F.col("__c")
    aggs = [F.max("__cum_total").alias(n or "__n")]
    for name, p in probs.items():
        h = (F.col("__cum_total") - 1) * F.lit(float(p))
        for tag, rank in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            aggs.append(F.max(F.when((lo_rank <= rank) & (rank < hi_rank), v)).alias(f"__{name}_{tag}"))
        aggs.append(F.max(h - F.floor(h)).alias(f"__{name}_w"))
    got = placed.groupBy(*keys).agg(*aggs)
    out = [F.col(k) for k in keys] + ([F.col(n)] if n else [])
    for name in probs:
        lo, hi, w = F.col(f"__{name}_lo"), F.col(f"__{name}_hi"), F.col(f"__{name}_w")
        out.append((lo + (hi - lo) * w).alias(name))
    return got.select(*out)


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str, weight: Column | None = None) -> DataFrame:
    """Rank of each distinct value (ties share their mean rank): keys, value, ``name``, ``n_tied``.

    ``weight`` is the number of rows a row stands for.
    """
    counted = df.groupBy(*keys, value).agg(F.sum(F.lit(1).cast("bigint") if weight is None else weight).alias("n_tied"))
    placed = ordered(counted, keys, [value], sums={"__cum": F.col("n_tied")})
    return placed.select(
        *keys, value, "n_tied",
        (F.col("__cum") - F.col("n_tied") + (F.col("n_tied") + 1) / F.lit(2.0)).alias(name),
    )
