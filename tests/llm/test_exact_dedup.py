import hashlib
import tempfile

from pyspark.sql import functions as F

from meridia.llm import exact_dedup as X

ROWS = [(1, "same"), (5, "same"), (3, "same"), (4, "Same"), (6, None), (2, ""), (7, "long " * 50000), (8, "long " * 50000), (None, "same"), (None, "alone"),
        (9, "twice"), (9, "twice")]


def test_against_brute_force(spark):
    df = spark.createDataFrame([(d, t, "x", 0) for d, t in ROWS], "doc_id long, text string, digest string, kept int")
    groups = {}
    for d, t in ROWS:
        groups.setdefault(t or "", []).append(d)
    best = {t: max((d for d in ids if d is not None), default=None) for t, ids in groups.items()}
    want = sorted((repr(d), repr(best[t or ""]), len(groups[t or ""]), d == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for d, t in ROWS)
    got = sorted((repr(r.doc_id), repr(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in X.exact_dedup(df).collect())
    assert got == want
    assert X.exact_dedup(df.limit(0)).count() == 0


def test_keep_one(spark):
    df = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(ROWS)], "doc_id long, text string, n long")
    got = sorted((repr(r.doc_id), r.text or "", r.n) for r in X.keep_one(df).collect())
    assert got == sorted([("5", "same", 1), ("4", "Same", 3), ("6", "", 4), ("8", "long " * 50000, 7), ("None", "alone", 9), ("9", "twice", 11)])


def test_one_digest_several_texts(spark, monkeypatch):
    """Bytes decide even if the digest does not: here all texts of one length share a digest."""
    monkeypatch.setattr(X, "digest_of", lambda text: F.unhex(F.sha2(F.octet_length(text).cast("string"), 256)))
    df = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "aa"), (4, "c")], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id, r.group_size) for r in X.exact_dedup(df).collect()} == {(1, 3, 2), (3, 3, 2), (2, 2, 1), (4, 4, 1)}


def test_state_goes_on_between_feeds(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    rows = lambda ids: spark.createDataFrame([(i, "t") for i in ids], "doc_id long, text string").select(
        "doc_id", X.digest_of(F.col("text")).alias("digest"), F.octet_length("text").cast("bigint").alias("n_bytes"))
    for ids in ([1, 2], [9], [4, 5]):
        rows(ids).write.mode("append").parquet(f"{root}/in")
        X.feed(spark, f"{root}/in", f"{root}/state")
    row = X.classes(spark, f"{root}/state").first()
    assert (row.keep_id, row.group_size, row.n_bytes) == (9, 5, 1)
