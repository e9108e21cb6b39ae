"""Toxicity: cumulative-link ordinal regression on sparse text features.

P(grade <= j) = sigmoid(threshold_j - w.x) with one weight vector for all ordered
thresholds.  Features say which lower-cased words, word beginnings and endings occur,
hashed to a fixed number of columns; weights are fitted in numpy by accelerated proximal
steps with an L1 penalty on a bounded sample of labelled texts, so few are left and
words that carry nothing cannot add up in long texts.  Weights are not negative: no
amount of clean text around it makes a toxic passage less severe.  The severity of a text is its
expected grade; it is rejected if P(grade >= 1) reaches a cut chosen on held-back rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.llm.common import map_slices
from meridia.llm.sampling import stratified
from meridia.llm.segments import Memo

LETTERS = re.compile(r"[^\W\d_]+")
COLUMNS, RARE = 1 << 20, 4


def features(word: str) -> tuple[int, ...]:
    """Columns of a word: itself, and its first and last three to five letters."""
    named = [f"={word}"]
    named += [f"<{word[:n]}" for n in (3, 4, 5) if len(word) > n] + [f">{word[-n:]}" for n in (4, 5) if len(word) > n]
    return tuple(zlib.crc32(x.encode()) % COLUMNS for x in named)


def words_of(text: str | None) -> set[str]:
    return set(LETTERS.findall((text or "").lower()))


#: Words a scorer remembers.
REMEMBERED = 100_000


@dataclass
class Model:
    """Non-zero weights by column, ordered thresholds, the grades they separate, the rejecting probability."""

    weights: dict[int, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)
    grades: list[int] = field(default_factory=lambda: [0])
    cut: float = 0.5

    def scorer(self):
        keep = self.weights.keys()
        known = Memo(lambda w: tuple(c for c in features(w) if c in keep), REMEMBERED)
        return lambda text: sum(self.weights[c] for c in sorted({c for w in words_of(text) for c in known[w]}))

    def reaching(self, z):
        """P(grade >= j) for every grade but the lowest: an array of texts x thresholds."""
        import numpy as np

        gap = np.clip(np.asarray(self.thresholds)[None, :] - np.asarray(z, dtype=float)[:, None], -60, 60)
        return 1 / (1 + np.exp(gap))


def sample(docs: DataFrame, grades: DataFrame, bound: int, id_col: str, text_col: str):
    """Collected rows (grade, columns, weight, apart) of at most about ``bound`` graded texts.

    The grades are sampled first; being bounded, they are sent to the texts.
    """
    graded = grades.select(F.col("doc_id").alias("g_id"), F.col("grade").cast("int").alias("grade")).where("grade IS NOT NULL")
    few = stratified(graded, "grade", bound, ["g_id"]).withColumn("apart", F.pmod(F.xxhash64("g_id"), F.lit(5)) == 0)
    texts = docs.select(docs[id_col].alias("g_id"), docs[text_col].alias("text")).where(F.col("text").isNotNull())
    picked = texts.join(F.broadcast(few), "g_id").select("text", "grade", "weight", "apart")

    def step():
        import numpy as np

        def one(t):
            cols = [sorted({c for w in words_of(x) for c in features(w)}) for x in t.column("text").to_pylist()]
            return {"grade": t.column("grade"), "cols": [np.array(c, "<i4").tobytes() for c in cols],
                    "weight": t.column("weight"), "apart": t.column("apart")}

        return one

    return map_slices(picked, step, "grade int, cols binary, weight double, apart boolean", rows=64).toPandas()


def fit(
    docs: DataFrame, grades: DataFrame, bound: int = 8000, penalties: tuple[float, ...] = (4e-3, 2e-3, 1e-3, 5e-4),
    rounds: int = 200, id_col: str = "doc_id", text_col: str = "text",
) -> Model:
    """Train on at most about ``bound`` rows of ``grades`` (doc_id, grade), chosen by hash and spread evenly over the grades.

    The penalty is the one of ``penalties`` that does best on the held-back fifth.  Rows
    without a text or grade are skipped; with fewer than two grades left the model
    rejects nothing.
    """
    import numpy as np

    got = sample(docs, grades, bound, id_col, text_col).sort_values(["grade", "cols"]).reset_index(drop=True)
    grades = sorted(got["grade"].unique().tolist())
    if len(grades) < 2:
        return Model(grades=grades or [0])
    cols = [np.frombuffer(x, "<i4") for x in got["cols"]]
    counts = np.bincount(np.concatenate(cols), minlength=COLUMNS)
    cols = [c[counts[c] >= RARE] for c in cols]
    y = np.searchsorted(grades, got["grade"].to_numpy())
    weight = got["weight"].to_numpy()
    apart = got["apart"].to_numpy(dtype=bool)
    train = np.flatnonzero(~apart) if len(set(y[~apart])) == len(grades) else np.arange(len(y))
    check = np.flatnonzero(apart) if len(set(y[apart] > 0)) == 2 else train
    best, best_f = None, -1.0
    for penalty in penalties:
        w, theta = _solve([cols[i] for i in train], y[train], len(grades) - 1, penalty, rounds)
        at = np.flatnonzero(w)
        model = Model(dict(zip(at.tolist(), w[at].tolist(), strict=True)), theta.tolist(), grades)
        p = model.reaching([w[cols[i]].sum() for i in check])[:, 0]
        f = _choose_cut(model, p, y[check] > 0, weight[check])
        if f > best_f + 1e-3:
            best, best_f = model, f
        if best_f > 0.999:
            break
    return best


def _solve(cols, y, k: int, penalty: float, rounds: int):
    """Weights (not negative, L1) and thresholds of least mean loss, by accelerated proximal steps.

    Only columns whose slope can overcome the penalty take part; after each solution
    columns that now could are let in, until there are none.
    """
    import numpy as np

    n = len(y)
    flat, rows = np.concatenate(cols), np.repeat(np.arange(n), [len(c) for c in cols])
    share = np.clip([(y > j).mean() for j in range(k)], 1e-6, 1 - 1e-6)
    w, theta = np.zeros(COLUMNS), -np.log(share / (1 - share))
    active = np.zeros(COLUMNS, bool)
    for _ in range(10):
        z = np.bincount(rows, w[flat], n)
        slope = np.bincount(flat, _slopes(z, theta, y)[0][rows], COLUMNS) / n
        fresh = ~active & (-slope > penalty)
        if not fresh.any():
            break
        active |= fresh
        place = np.cumsum(active) - 1
        inside = active[flat]
        sub_c, sub_r, m = place[flat[inside]], rows[inside], int(active.sum())

        def loss(v, sub_c=sub_c, sub_r=sub_r, m=m):
            z = np.bincount(sub_r, v[sub_c], n)
            edge = np.concatenate([[-np.inf], v[m:], [np.inf]])
            mass = _cdf(edge[y + 1] - z) - _cdf(edge[y] - z)
            return -np.log(np.maximum(mass, 1e-12)).mean()

        def gradient(v, sub_c=sub_c, sub_r=sub_r, m=m):
            dz, dt = _slopes(np.bincount(sub_r, v[sub_c], n), v[m:], y)
            return np.concatenate([np.bincount(sub_c, dz[sub_r], m), dt]) / n

        def step(v, g, size, m=m):
            out = v - size * g
            out[:m] = np.maximum(out[:m] - size * penalty, 0)
            out[m:] = np.maximum.accumulate(out[m:])
            return out

        now = ahead = np.concatenate([w[active], theta])
        size, pace = 1.0, 1.0
        for _ in range(rounds):
            g, here = gradient(ahead), loss(ahead)
            while True:
                new = step(ahead, g, size)
                d = new - ahead
                if loss(new) <= here + g @ d + d @ d / (2 * size) + 1e-12 or size < 1e-6:
                    break
                size /= 2
            faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
            ahead = new + (pace - 1) / faster * (new - now)
            ahead[m:] = np.maximum.accumulate(ahead[m:])
            moved = np.abs(new - now).max()
            now, pace, size = new, faster, size * 1.2
            if moved < 1e-4:
                break
        w[:] = 0
        w[active], theta = now[:m], now[m:]
    return w, theta


def _cdf(x):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _slopes(z, theta, y):
    """Derivatives of the negative log likelihood by score and by thresholds."""
    import numpy as np

    k = len(theta)
    edge = np.concatenate([[-np.inf], theta, [np.inf]])
    high, low = _cdf(edge[y + 1] - z), _cdf(edge[y] - z)
    mass = np.maximum(high - low, 1e-9)
    up, down = high * (1 - high) / mass, low * (1 - low) / mass
    dt = np.zeros(k)
    np.add.at(dt, y[y < k], -up[y < k])
    np.add.at(dt, y[y > 0] - 1, down[y > 0])
    return up - down, dt


def _choose_cut(model: Model, p, bad, weight) -> float:
    """Cut at the best weighted F0.5, in the middle of the gap below that probability; returns that F0.5."""
    import numpy as np

    order = np.argsort(-p, kind="stable")
    hit, all_ = np.cumsum((weight * bad)[order]), np.cumsum(weight[order])
    f = 1.25 * hit / (all_ + 0.25 * (weight * bad).sum())
    last = np.concatenate([p[order][1:] < p[order][:-1], [True]])
    best = int(np.argmax(np.where(last, f, -1)))
    below = p[order][best + 1] if best + 1 < len(p) else 0.0
    model.cut = float((p[order][best] + below) / 2)
    return float(f[best])


def scored(docs: DataFrame, model: Model, text_col: str = "text", name: str = "severity") -> DataFrame:
    """``docs`` with one struct column: expected grade, most likely grade, P(grade above the lowest), toxic.

    NULL and empty texts score as texts without features.  Rows are independent, so NULL
    or repeated ids change nothing; a column of the same name is replaced; an empty table
    gives no rows.  A model without two grades finds nothing toxic.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most COLUMNS weights
    kind = "severity double, grade int, p_toxic double, toxic boolean"

    @F.pandas_udf(kind)
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import numpy as np

        m = sent.value
        score = m.scorer()
        for texts in batches:
            reach = m.reaching([score(x) for x in texts]) if m.thresholds else np.zeros((len(texts), 0))
            grades = np.asarray(m.grades)
            each = np.hstack([np.ones((len(texts), 1)), reach, np.zeros((len(texts), 1))])
            mass = each[:, :-1] - each[:, 1:]
            p = reach[:, 0] if reach.shape[1] else np.zeros(len(texts))
            yield pd.DataFrame({
                "severity": mass @ grades, "grade": grades[mass.argmax(axis=1)].astype("int32"), "p_toxic": p,
                "toxic": (p >= m.cut) & (reach.shape[1] > 0)})

    return docs.withColumn(name, rate(docs[text_col]))


def rejected(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row) of the rows the model rejects; ``row`` is a hash of the text.

    Only ids leave the Python workers, so a stage that drops these rows need not send its
    texts back.  NULL texts count as empty; NULL ids stay NULL; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most COLUMNS weights
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))

    def step():
        import numpy as np

        m = sent.value
        score = m.scorer()

        def one(t):
            bad = np.zeros(0, np.int64)
            if m.thresholds:
                bad = np.flatnonzero(m.reaching([score(x) for x in t.column("text").to_pylist()])[:, 0] >= m.cut)
            return {c: t.column(c).take(bad) for c in ("doc_id", "row")}

        return one

    return map_slices(rows, step, "doc_id bigint, row bigint")


def grade_of(toxic: Column, quality: Column) -> Column:
    """Grades of the labels table: 0 clean, 1 toxic, 2 toxic and of low quality; NULL if not labelled."""
    return F.when(toxic == 0, 0).when((toxic == 1) & (quality == 0), 2).when(toxic == 1, 1)


def fit_labels(docs: DataFrame, labels: DataFrame, bound: int = 8000) -> Model:
    """Fitted on the documents that a table (doc_id, quality, toxic) covers; repeated labels count by their highest grade."""
    graded = labels.groupBy("doc_id").agg(F.max(grade_of(F.col("toxic"), F.col("quality"))).alias("grade"))
    return fit(docs, graded, bound=bound)
