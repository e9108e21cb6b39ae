import random

import numpy as np

from meridia.llm import language


def texts(seed, n):
    rnd = random.Random(seed)
    parts = {"aa": ["ra", "ko", "mi", "tu"], "bb": ["sch", "ung", "eit", "ver"], "cc": ["ção", "ñi", "lla", "or"]}
    out = []
    for i in range(n):
        lang = rnd.choice(sorted(parts))
        words = ["".join(rnd.choice(parts[lang]) for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(3, 60))]
        out.append((i, " ".join(words).capitalize(), lang))
    return out


def test_held_out_accuracy_and_odd_rows(spark):
    rows = texts(1, 600)
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    extra = [(1000, None, None), (1001, "", "aa"), (1002, "123 ... ½ ²", "aa"), (None, "schung", None)]
    model = language.fit(train.unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string")), bound=300)
    fresh = texts(2, 300)
    test = spark.createDataFrame([(d, t, "wrong", 1.0) for d, t, _ in fresh] + [(d, t, x, 0.0) for d, t, x in extra] + [(5000, "Verung " * 60000, "x", 0.0)],
                                 "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in language.predict(test, model).collect()}
    assert len(got) == 305
    assert np.mean([got[d].lang_pred == x for d, _, x in fresh]) > 0.97
    assert {got[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and got[1000].rejected and got[1000].score == 0
    assert got[5000].lang_pred == "bb" and all(0 <= r.score <= 1 for r in got.values())
    assert language.predict(test.limit(0), model).count() == 0


def test_reruns_agree_and_no_language(spark):
    df = spark.createDataFrame(texts(3, 120), "doc_id long, text string, lang string")
    one, two = language.fit(df, bound=90), language.fit(df.repartition(7), bound=90)
    assert np.array_equal(one.table, two.table) and one.accept == two.accept
    none = language.fit(df.where("lang = 'zz'"))
    assert {r.lang_pred for r in language.predict(df, none).collect()} == {"und"}


def test_query_accuracy(spark):
    from meridia.llm.queries import catalog

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = catalog.queries["op7_language"](spark, sf).join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
