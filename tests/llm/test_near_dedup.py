import math
import random
import re

import numpy as np
import pytest

from meridia.llm import near_dedup
from meridia.llm.graph import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)])


def brute(rows, k, percent=80):
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted((d is not None, d or 0, len(sets[i]), least.get(top(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))


def rows(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["Étude", "die", "THE", "The"]
    text = lambda n: [rnd.choice(vocab) for _ in range(n)]
    docs = [" ".join(text(rnd.randrange(1, 80))) for _ in range(120)]
    for _ in range(6):  # chains and clusters of near copies
        base = text(rnd.randrange(40, 120))
        for _ in range(15):
            base = list(base)
            if rnd.random() < 0.7:
                base[rnd.randrange(len(base))] = rnd.choice(vocab)
            docs.append((" " if rnd.random() < 0.5 else "\n\t").join(base))
    passage = text(40)
    docs += [" ".join(passage + text(rnd.randrange(5, 60))) for _ in range(40)]
    docs += [docs[3], docs[3].upper(), "", None, "   ", "a b", "A  B", "a b c"]
    rnd.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("k,tile", [(4, 256), (5, 3)])
def test_against_brute_force(spark, monkeypatch, k, tile):
    monkeypatch.setattr(near_dedup, "TILE", tile)
    monkeypatch.setattr(near_dedup, "COLUMNS", 64)
    data = rows(k) + [(None, "a b c"), (None, None), (7, "repeated row here now"), (7, "repeated row here now")]
    df = spark.createDataFrame([(d, t, 0, "x") for d, t in data], "doc_id long, text string, node int, row string")
    got = near_dedup.near_duplicates(df, shingle=k).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_shingles, r.component_id) for r in got) == brute(data, k)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_keep_one_and_empty(spark):
    data = [(1, "a b c d e f g"), (2, "A b c d e f g"), (3, "other words in this text"), (4, None)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert {r.doc_id for r in near_dedup.keep_one(df).collect()} == {1, 3, 4}
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_bounds():
    assert near_dedup.least_matches(29, 0.8, 1e-5) < near_dedup.least_matches(29, 0.8, 1e-2) < 29
    assert near_dedup.least_matches(100, 0.8, 0.5) in range(79, 83)


def test_components(spark):
    rnd = random.Random(2)
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(rnd.randrange(200, 400), rnd.randrange(200, 400)) for _ in range(120)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    up = {x: x for e in links if e[0] != e[1] for x in e}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        if a != b:
            x, y = sorted((top(a), top(b)))
            up[y] = x
    assert got == {i: top(i) for i in up}


def test_batches_together_keep_to_the_miss_rate():
    """All five tests in a row drop a pair just at the threshold no more often than documented."""
    def lost(least, s=0.8, bands=29):
        alive, out = np.array([1.0]), 0.0
        one = np.array([math.comb(bands, k) * s ** k * (1 - s) ** (bands - k) for k in range(bands + 1)])
        for m in least:
            alive = np.convolve(alive, one)
            out += alive[:m].sum()
            alive[:m] = 0
        return out

    assert lost([13, 33, 53, 74, 95]) > 4e-5
    assert lost([m for _, _, m in near_dedup._bounds(29, 5, 0.8, 1e-5)]) <= 1e-5
