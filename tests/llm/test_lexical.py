import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from meridia.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    bags = [(d, Counter(words(t)), len(words(t))) for d, t in docs if words(t)]
    n_docs, length = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in items:
        scores = []
        for d, bag, n in bags:
            m = 25 + (75 * n * n_docs) // length
            s = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m))
                for t in words(text) if bag[t])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, r, None if a else d, -s) for r, (s, a, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1 << 16, 60])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lexical, "BLOCK", block)
    rnd = random.Random(5)
    lexicon = ["the", "The", "été", "Été", "x1", "ÀB", "naïve", "中文", "a", "b", "c", "d", "e", "rare"]
    text = lambda n: rnd.choice([" ", "-", "\n", "_"]).join(rnd.choice(lexicon) for _ in range(n))
    docs = [(i, text(rnd.randrange(1, 40))) for i in range(120)]
    docs += [(None, text(20)), (None, "rare"), (300, None), (301, ""), (302, " .,!"), (5, docs[5][1]), (5, "the rare"), (303, "the " * 30000)]
    items = [(i, text(rnd.randrange(1, 15))) for i in range(12)] + [(3, "rare the"), (None, "été"), (50, None), (51, "?!"), (52, "absent"), (1, None)]
    items.append(items[0])
    d = spark.createDataFrame([(a, b, 1, "x") for a, b in docs], "doc_id long, text string, item int, terms string").repartition(5)
    q = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, rank int")
    got = lexical.rank_documents(d, q, k=4)
    assert sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == brute(docs, items, 4)
    if block > 60:
        assert lexical.rank_documents(d.limit(0), q).count() == 0 == lexical.rank_documents(d, q.limit(0)).count()


def test_shared_sums_add_up():
    rnd = random.Random(6)
    common = rnd.sample(range(300), 40)
    queries = [
        {t: rnd.choice([1, 1, 1, 2]) for t in [*rnd.sample(common, 20), *rnd.sample(range(300), rnd.randrange(0, 30))]} for _ in range(30)]
    queries += [{}, {5: 3}, dict(queries[0])]
    plan = lexical.share(queries)
    assert len(plan.left) > 20 and plan.levels[-1] == len(plan.left)
    # every sum serves two items at least, and the DAG takes fewer additions than the plain sums
    serves = [{i for i, nodes in enumerate(plan.items) if n in nodes} for n in range(plan.nodes)]
    for s in reversed(range(len(plan.left))):
        for child in (plan.left[s], plan.right[s]):
            serves[child] |= serves[plan.classes + s]
    assert all(len(x) > 1 for x in serves[plan.classes:])
    assert len(plan.leaf_term) + len(plan.left) + sum(map(len, plan.items)) < sum(map(len, queries))
    value = np.arange(300, dtype=np.int64) ** 2 + 1
    leaf = np.arange(len(plan.leaf_term))
    got = lexical.accumulate(plan, np.zeros(len(leaf), int), leaf, value[plan.leaf_term] * np.asarray(plan.leaf_times), 1)
    for q, nodes in zip(queries, plan.items, strict=True):
        assert sum(got[n, 0] for n in nodes) == sum(int(value[t]) * times for t, times in q.items())


def test_stretches_keep_terms_whole(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 5)
    text = "abcdefghij éé, x ÉAZ[0]" * 3
    assert [t.decode() for some in lexical.terms(text.encode()) for t in some] == words(text)
