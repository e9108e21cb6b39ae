"""Rankings, top-k and set agreement that never sort a whole group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions.columns import micros
from meridia.operators.ordered import ordered


def rank_within(df: DataFrame, group: str, value: str, k: int = 2) -> DataFrame:
    """Rows with RANK() <= k by value descending inside each group, ties kept, NULL values removed.

    Works on distinct (group, value) counts: the k largest of them per group are a
    bounded table, and joining them back keeps every tied row.
    """
    rows = df.where(F.col(value).isNotNull())
    distinct = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(group).orderBy(F.desc(value))
    # row_number() <= k lets Spark keep k rows per group before the shuffle
    top = distinct.withColumn("i", F.row_number().over(w)).where(F.col("i") <= k)
    before = F.coalesce(F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    top = top.withColumn("rk", before + 1).where(F.col("rk") <= k).select(group, value, "rk")
    return rows.join(top, [group, value])


def importance_rank(df: DataFrame, name: str, value: str, rank: str = "rank") -> DataFrame:
    """1..p by value descending, name ascending on ties."""
    keyed = df.withColumn("__neg", -F.col(value))
    return ordered(keyed, [], ["__neg", name], pos=rank).drop("__neg")


def top_k(df: DataFrame, name: str, value: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(value), name).limit(k)


def cumulative_share(df: DataFrame, name: str, value: str) -> DataFrame:
    """Running share of the total, largest first."""
    keyed = df.withColumn("__neg", -F.col(value))
    out = ordered(keyed, [], ["__neg", name], pos="rank", sums={"__cum": F.col(value)}, totals=True)
    return out.select(name, value, "rank", F.try_divide("__cum", "__cum_total").alias("cumulative"))


def concentration(df: DataFrame, name: str, value: str, thresholds=(0.80, 0.90, 0.95)) -> DataFrame:
    """How many top features first reach each share of the total; a total of 0 is an error."""
    total = df.agg(F.sum(value)).first()[0]
    if not total or total <= 0:
        raise ValueError("total importance is zero: nothing is attributed")
    cum = cumulative_share(df, name, value)
    row = cum.agg(*[(F.count_if(F.col("cumulative") < t) + 1).alias(f"t{i}") for i, t in enumerate(thresholds)],
                  F.count(F.lit(1)).alias("n_total"))
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("n_features"), "n_total")
        for i, t in enumerate(thresholds)
    ])))


def near_zero(df: DataFrame, value: str, share: float = 1e-6) -> DataFrame:
    top = df.agg(F.max(value)).first()[0]
    return df.agg(F.count_if(F.col(value) < F.lit(top) * share).alias("n_near_zero"), F.count(F.lit(1)).alias("n"))


def topk_agreement(rankings: dict[str, DataFrame], name: str, value: str, k: int = 5) -> DataFrame:
    """Size of the overlap of the top-k sets, for each pair of rankings and for all of them."""
    tops = {r: top_k(df, name, value, k).select(name) for r, df in rankings.items()}
    names = list(tops)
    combos = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]] + [tuple(names)]
    out = None
    for combo in combos:
        both = tops[combo[0]]
        for other in combo[1:]:
            both = both.intersect(tops[other])
        row = both.agg(F.count(F.lit(1)).alias("overlap")).select(F.lit("&".join(combo)).alias("sets"), "overlap")
        out = row if out is None else out.unionByName(row)
    return out


def densest_window(series: DataFrame, hours: float = 60.0) -> DataFrame:
    """Earliest start whose forward window [t, t + hours) holds most readings, per subject.

    Every reading also sends a probe to the end of its window; one running count
    over readings and probes gives both ends, without a range frame per subject.
    """
    span = int(hours * 3_600_000_000)
    at = micros("ts")
    rows = series.where(F.col("ts").isNotNull()).select("subject_id", at.alias("at"), F.lit(1).alias("kind"), "seq")
    probes = rows.select("subject_id", (F.col("at") + span).alias("at"), F.lit(0).alias("kind"), "seq")
    counted = ordered(rows.unionByName(probes), ["subject_id"], ["at", "kind", "seq"],
                      sums={"seen": F.col("kind").cast("bigint")})
    is_row = F.col("kind") == 1
    spans = counted.groupBy("subject_id", "seq").agg(
        F.max(F.when(is_row, F.col("at"))).alias("start"), F.max(F.when(is_row, F.col("seen"))).alias("pos"),
        F.max(F.when(~is_row, F.col("seen"))).alias("end_seen"),
    ).withColumn("n", F.col("end_seen") - F.col("pos") + 1)
    best = F.max_by(F.struct("start", "n"), F.struct("n", -F.col("pos")))
    return spans.groupBy("subject_id").agg(best.alias("b")).select(
        "subject_id", F.timestamp_micros("b.start").alias("start_ts"), F.col("b.n").alias("n_readings")
    )


def union_distinct(sets: list[DataFrame]) -> DataFrame:
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    return out.distinct()
