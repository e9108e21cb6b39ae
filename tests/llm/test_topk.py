import math
import random

import pytest

from meridia.llm import topk


def brute(rows, k, every):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in {(i, tuple(v)) for i, v in ok if i % every == 0}:
        hits = sorted((-sum(x * y for x, y in zip(a, v, strict=True)), i) for i, v in ok if i != q and len(v) == len(a))
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(hits[:k])}
    return out


@pytest.mark.parametrize("k", [1, 5, 600])
def test_against_brute_force(spark, monkeypatch, k):
    monkeypatch.setattr(topk, "BLOCK", 4)
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(6)]) for i in range(500)]
    rows += [(i, [0.5] * 6) for i in range(500, 560)] + [(None, [1.0] * 6), (1001, None), (1002, [1.0, None] * 3)]
    rows += [(1003, [float("nan")] * 6), (1004, [float("inf")] * 6), (1050, [1.0, 2.0]), (1051, [3.0, 4.0]), (1100, []), (1101, [])]
    df = spark.createDataFrame([(a, b, 7) for a, b in rows], "vec_id long, embedding array<double>, score int")
    got = {tuple(r) for r in topk.top_k(df, k=k, every=50).collect()}
    assert got == brute(rows, k, 50)


def test_only_reached_pairs_travel(spark, monkeypatch):
    """Rows in tight groups far apart: every pair routed reaches its floor, all that do are routed, and they are few."""
    seen = {}
    real = topk.routed
    monkeypatch.setattr(topk, "routed", lambda boxes, asked: seen.update(boxes=boxes, asked=asked) or real(boxes, asked))
    monkeypatch.setattr(topk, "SHARD", 20)
    rnd = random.Random(5)
    rows = []
    for i in range(800):
        centre = [0.0] * 4
        centre[i % 4] = 40.0 if i % 8 < 4 else -40.0
        rows.append((i, [c + rnd.random() for c in centre]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in topk.top_k(df, k=5, every=50).collect()} == brute(rows, 5, 50)
    boxes, asked = seen["boxes"].collect(), seen["asked"].collect()
    assert {a["query_id"] for a in asked} == set(range(0, 800, 50)) and all(a["floor"] is not None for a in asked)
    reach = {(a["query_id"], b["cell"]) for a in asked for b in boxes
             if sum(max(q * lo, q * hi) for q, lo, hi in zip(a["v"], b["low"], b["high"], strict=True)) >= a["floor"]}
    pairs = [(r["query_id"], r["cell"]) for r in real(seen["boxes"], seen["asked"]).collect()]
    assert sorted(pairs) == sorted(reach) and len(pairs) < len(asked) * len(boxes) / 2


def test_one_vector_of_a_third_and_one_row_repeated(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 16)
    rnd = random.Random(9)
    rows = [(i, [0.25, 0.5, -1.0]) for i in range(150)] + [(777, [1.0, 1.0, 1.0])] * 90
    rows += [(i, [rnd.gauss(0, 1) for _ in range(3)]) for i in range(200, 360)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, k=5, every=50).collect())
    assert got == sorted(brute(rows, 5, 50))


def test_large_components_and_empty(spark):
    rows = [(0, [3e12, -2e12]), (1, [3e12, 1e12]), (2, [-1e12, 5e11])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df, k=5, every=50).orderBy("rank").collect()]
    limit = (1 << 63) - 1
    assert got == [(0, 1, 1, limit), (0, 2, 2, -limit - 1)]
    assert topk.top_k(df.limit(0)).count() == 0


def test_repeated_rows(spark):
    rows = [(0, [1.0]), (0, [1.0]), (0, [2.0]), (7, [1.0]), (7, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.top_k(df, k=5, every=50).collect())
    assert got == [(0, 1, 7, 65536), (0, 1, 7, 131072), (0, 2, 7, 65536), (0, 2, 7, 131072)]
