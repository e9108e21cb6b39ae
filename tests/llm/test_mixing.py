import hashlib
import random
import re

import pytest

from meridia.llm import mixing


def rows(seed, n):
    rnd = random.Random(seed)
    sources = ["a", "B", "é", "zz", None, "a b"]
    return [(i, " ".join(["w"] * rnd.randrange(0, 60)) if rnd.random() < 0.95 else None, rnd.choices(sources, [9, 3, 3, 2, 1, 1])[0]) for i in range(n)]


def size(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def goals(data, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Reshare step by step, as the rule says."""
    total = {}
    for _, t, s in data:
        total[s] = total.get(s, 0) + size(t)
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, goal = share * sum(total.values()), set(order), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > cap * total[s]}
        if not full:
            return goal | {s: level * w[s] for s in open_}, total
        for s in full:
            goal[s] = cap * total[s]
            left -= goal[s]
        open_ -= full
    return goal, total


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_and_positions(spark, seed):
    data = rows(seed, 300) + [(None, "one two", "a"), (5, "again here", "B"), (5, "again here", "B")]
    df = spark.createDataFrame([(d, t, s, 1) for d, t, s in data], "doc_id long, text string, source string, size int")
    got = mixing.plan(df).collect()
    goal, total = goals(data)
    assert len(got) == len(data)
    by_target = {round(goal[s], 6): s for s in goal}
    taken = dict.fromkeys(goal, 0)
    for r in got:
        s = by_target[round(r.target, 6)]
        assert r.source_size == total[s] and len(r.positions) <= 2 and r.positions == sorted(r.positions)
        taken[s] += r.size * len(r.positions)
    largest = max(size(t) for _, t, _ in data)
    assert all(abs(taken[s] - goal[s]) <= largest / 2 + 1e-6 for s in goal)
    again = mixing.plan(df.repartition(11)).collect()
    key = lambda r: (repr(r.doc_id), r.row, r.size, tuple(r.positions))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_order_inside_a_source_and_mix(spark):
    data = rows(4, 200)
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    first = {r.doc_id: r.positions for r in mixing.plan(df).collect()}
    mine = sorted((d for d, _, s in data if s == "a" and first[d]), key=lambda d: hashlib.md5(str(d).encode()).hexdigest())
    assert [first[d][0] for d in mine] == sorted(first[d][0] for d in mine)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {d: len(p) for d, p in first.items() if p}
    assert mixing.plan(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0


def test_inverted_schedule(spark):
    knots = [(0.0, 0.5), (0.5, 0.5), (1.0, 2.0)]
    got = spark.range(0, 101).select("id", mixing.invert(knots, (mixing.F.col("id") / 100)).alias("t")).collect()
    area = lambda t: (0.5 * t if t <= 0.5 else 0.25 + 0.5 * (t - 0.5) + 1.5 * (t - 0.5) ** 2) / 0.875
    assert all(abs(area(r.t) - r.id / 100) < 1e-9 for r in got)
