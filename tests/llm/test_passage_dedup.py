import random
import re

import pytest

from meridia.llm import passage_dedup


def brute(rows, window):
    """rows: (doc_id, text) in the order that decides."""
    seen, out = set(), []
    for doc, text in rows:
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i:i + window])
            if key in seen:
                gone[i:i + window] = [True] * window
            seen.add(key)
        out.append((doc, len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("window,seed", [(20, 1), (7, 2), (4, 3)])
def test_against_brute_force(spark, window, seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["é", "Ünï", "a" * 3000]
    some = lambda n: [rnd.choice(vocab) for _ in range(n)]
    passages = [some(rnd.randrange(window - 2, 4 * window)) for _ in range(8)]
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one two")]
    for i in range(4, 120):
        words = []
        for _ in range(rnd.randrange(0, 6)):
            words += rnd.choice(passages) if rnd.random() < 0.6 else some(rnd.randrange(1, 30))
        rows.append((i, rnd.choice([" ", "\n", "  \t"]).join(words)))
    rows += [(200, rows[50][1]), (201, " ".join(["x"] * 100)), (202, " ".join(["x"] * 100))]
    mixed = list(rows)
    rnd.shuffle(mixed)
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in mixed], "doc_id long, text string, chunk int, row int")
    got = sorted(tuple(r) for r in passage_dedup.dedup_passages(df, window=window).collect())
    assert got == brute(rows, window)


def test_null_and_repeated_ids(spark):
    long = " ".join(f"v{i}" for i in range(30))
    df = spark.createDataFrame([(5, long), (5, long), (None, long), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in passage_dedup.dedup_passages(df).collect())
    assert got == [(0, 0, 0), (0, 30, 0), (5, 30, 30), (5, 30, 30)]
    assert passage_dedup.dedup_passages(df.limit(0)).count() == 0


def test_whole_table(spark):
    from meridia.llm.queries import catalog

    sf = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r.doc_id: (r.n_words, r.n_removed) for r in catalog.queries["op2_passage_dedup"](spark, sf).collect()}
    assert got == {d: (n, k) for d, n, k, _ in brute(rows, 20)}


def test_texts_are_shuffled_once(spark):
    from meridia.llm.common import table

    plan = passage_dedup.dedup_passages(table(spark, "/root/testdata/sf0.001", "documents"))
    plan.collect()
    shown = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert shown.count("FileScan") == 1, shown
