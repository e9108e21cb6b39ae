import math
import zlib

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F
from test_mixing import goals, size
from test_near_dedup import brute as near

import corpus_pipeline
from meridia.llm import byte_bpe, toxicity
from meridia.session import durable

SF = "/root/testdata/sf0.001"


def p_toxic(model, text):
    """P(severity above the lowest) written out from the stored weights: sparse binary features, first threshold."""
    words, word = set(), ""
    for c in (text or "").lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            words.add(word)
            word = ""
    named = set()
    for w in words:
        named.add("=" + w)
        named |= {"<" + w[:n] for n in (3, 4, 5) if len(w) > n} | {">" + w[-n:] for n in (4, 5) if len(w) > n}
    z = sum(model.weights.get(c, 0.0) for c in {zlib.crc32(x.encode()) % (1 << 20) for x in named})
    return 1 - 1 / (1 + math.exp(-(model.thresholds[0] - z)))


def test_odd_rows(spark):
    """NULL ids and texts, repeated rows, names the stages use themselves, a very long text, and an empty table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").limit(60)
    odd = [(None, "no id at all", "a"), (None, None, None), (900001, None, "a"), (900002, "", "a"), (900003, "long text " * 40000, "b"), (900004, "twice", "b"), (900004, "twice", "b")]
    both = docs.union(spark.createDataFrame(odd, docs.schema))
    both = durable(both.withColumn("_severity", F.col("doc_id")).withColumn("row", F.lit("r")).withColumn("node", F.lit(1)), "odd")
    for rows in (both, both.limit(0)):
        kept = rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = durable(stage(spark, kept, SF), name)
            assert kept.columns == both.columns and kept.schema["_severity"].dataType == both.schema["doc_id"].dataType
            assert kept.where("NOT _severity <=> doc_id OR row <> 'r' OR node <> 1").isEmpty()
        last = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
        ids = {r.doc_id for r in last.collect()}
    assert ids == set()
    kept = durable(corpus_pipeline.without_near_copies(spark, corpus_pipeline.without_copies(spark, both, SF), SF), "kept")
    left = [(r.doc_id, r.text) for r in kept.where("doc_id > 900000 OR doc_id IS NULL").collect()]
    assert sorted(left, key=str) == sorted([(None, "no id at all"), (900002, ""), (900003, "long text " * 40000), (900004, "twice")], key=str)


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["without_toxic", "without_copies", "without_near_copies", "mixed", "tokenized"]
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(durable(stage(spark, kept[-1], SF), name))
        assert kept[-1].columns == docs.columns
    rows = [sorted((r.doc_id, r.text or "", r.source) for r in k.collect()) for k in kept]

    model = toxicity.fit_labels(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    bad = [p_toxic(model, t) >= model.cut for _, t, _ in rows[0]]
    assert rows[1] == [r for r, x in zip(rows[0], bad, strict=True) if not x] and sum(bad) < 0.3 * len(bad)
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    known = [(toxic[d], x) for (d, _, _), x in zip(rows[0], bad, strict=True) if d in toxic]
    assert sum(t == x for t, x in known) >= 0.95 * len(known)

    best = {}
    for d, t, _ in rows[1]:
        best[t] = max(d, best.get(t, d))
    assert rows[2] == [r for r in rows[1] if best[r[1]] == r[0]]

    groups = {d: root for _, d, _, root in near([(d, t) for d, t, _ in rows[2]], 5)}
    assert rows[3] == [r for r in rows[2] if groups[r[0]] == r[0]]

    goal, _ = goals([(d, t, s) for d, t, s in rows[3]])
    taken = dict.fromkeys(goal, 0)
    for r in rows[4]:
        taken[r[2]] += size(r[1])
    largest = max(size(t) for _, t, _ in rows[3])
    assert set(rows[4]) <= set(rows[3]) and all(abs(taken[s] - goal[s]) <= largest / 2 + 1e-6 for s in goal)
    assert all(rows[4].count(r) <= 2 for r in set(rows[4]))

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(f.read()), special_tokens={})
    got = sorted((r.doc_id, bytes(r.ids)) for r in corpus_pipeline.STAGES[-1][1](spark, kept[-1], SF).collect())
    assert got == sorted((d, b"".join(i.to_bytes(4, "little") for i in enc.encode_ordinary(t))) for d, t, _ in rows[4])


def test_a_sweep_asks_every_core_to_collect(spark):
    from meridia.llm.common import sweep

    spark.sparkContext.setJobGroup("swept", "swept")
    sweep(spark)
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(k) for j in tracker.getJobIdsForGroup("swept") for k in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sum(s.numTasks for s in stages) == spark.sparkContext.defaultParallelism
