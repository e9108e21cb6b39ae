import random

import numpy as np

from meridia.llm import toxicity


def rows(seed, n):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    out = []
    for i in range(n):
        grade = rnd.choice([0, 0, 0, 1, 2])
        words = [rnd.choice(vocab) for _ in range(rnd.randrange(5, 120))]
        words += {0: [], 1: ["grolx" + rnd.choice("aeiou")], 2: ["grolxa", "vekkun"]}[grade]
        rnd.shuffle(words)
        out.append((i, " ".join(words), grade))
    return out


def test_grades_and_cut(spark):
    data = rows(1, 900)
    docs = spark.createDataFrame([(d, t) for d, t, _ in data] + [(None, "x"), (5000, None)], "doc_id long, text string")
    grades = spark.createDataFrame([(d, g) for d, _, g in data] + [(5000, 0), (5001, 1), (3, None)], "doc_id long, grade int")
    model = toxicity.fit(docs, grades.where("doc_id <> 3 OR grade IS NOT NULL"), bound=900)
    assert model.thresholds == sorted(model.thresholds) and len(model.thresholds) == 2 and min(model.weights.values()) > 0
    fresh = rows(2, 300)
    test = spark.createDataFrame([(d, t, 9) for d, t, _ in fresh] + [(None, None, 9), (7000, "", 9), (7001, "grolxi " + "hhh " * 90000, 9)],
                                 "doc_id long, text string, toxic int")
    got = {r.doc_id: r for r in toxicity.scored(test, model).collect()}
    assert len(got) == 303 and got[None].toxic == 9
    right = [got[d].severity.toxic == (g > 0) for d, _, g in fresh]
    assert np.mean(right) > 0.97
    assert np.mean([got[d].severity.grade == g for d, _, g in fresh]) > 0.9
    assert not got[None].severity.toxic and not got[7000].severity.toxic and got[7001].severity.toxic
    assert all(0 <= r.severity.severity <= 2 for r in got.values())
    assert toxicity.scored(test.limit(0), model).count() == 0


def test_one_grade_rejects_nothing(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, grade int"))
    assert [r.severity.toxic for r in toxicity.scored(docs, model).collect()] == [False, False]


def test_slopes_match_differences():
    rng = np.random.default_rng(0)
    y, z, theta = rng.integers(0, 3, 40), rng.normal(size=40), np.array([-0.3, 0.8])

    def loss(z, theta):
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        return -np.log(toxicity._cdf(edge[y + 1] - z) - toxicity._cdf(edge[y] - z))

    dz, dt = toxicity._slopes(z, theta, y)
    e = 1e-6
    assert np.allclose(dz, (loss(z + e, theta) - loss(z - e, theta)) / (2 * e), atol=1e-5)
    for j in range(2):
        step = e * np.eye(2)[j]
        assert np.isclose(dt[j], (loss(z, theta + step) - loss(z, theta - step)).sum() / (2 * e), atol=1e-4)
