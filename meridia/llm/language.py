"""Language ID: averaged hashed subword embeddings under a linear softmax.

A word is the mean of the embeddings of its character n-grams (hashed to a fixed
number of rows), a text the mean of its words; a linear softmax gives the language.
Embeddings and softmax are trained by stochastic gradient descent in numpy on a
bounded sample whose n-gram weights were formed by Spark.  A held-back fifth of the
sample calibrates the softmax temperature and the score below which a prediction
should be rejected.  Since everything before the softmax is a mean, the trained model
is one row of language scores per n-gram; workers remember the scores of words.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.llm.common import map_slices
from meridia.llm.sampling import stratified
from meridia.llm.segments import Memo

LETTERS = re.compile(r"[^\W\d_]+")
NONE = "und"
ROWS, NGRAMS, LONG_WORD, REMEMBERED = 1 << 14, (1, 2, 3), 40, 300_000


_GRAM = Memo(lambda gram: zlib.crc32(gram.encode()) % ROWS)


def subwords(word: str) -> list[int]:
    """Rows of the n-grams of ``<word>``; words beyond 40 letters by their stretches of 40."""
    out = []
    for at in range(0, len(word), LONG_WORD):
        w = f"<{word[at:at + LONG_WORD]}>"
        out += [_GRAM[w[i:i + n]] for n in NGRAMS for i in range(len(w) - n + 1)]
    return out


def words_of(text: str | None) -> list[str]:
    """Lower-cased letter runs; none if no character is a letter."""
    words = LETTERS.findall((text or "").lower())
    return words if any(c.isalpha() for w in words for c in w) else []


@dataclass
class Model:
    """Languages, scores per n-gram row and language, bias, temperature, least score to accept."""

    languages: list[str]
    table: object
    bias: object
    temperature: float = 1.0
    accept: float = 0.0

    def logits(self, mean):
        return (mean + self.bias) / self.temperature


def softmax(z):
    import numpy as np

    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _sparse(words: list[str]) -> tuple[bytes, bytes]:
    """A text as the mean of its words: n-gram rows and their weights, adding up to 1."""
    import numpy as np

    rows = np.zeros(ROWS, dtype="f8")
    for w in words:
        ids = subwords(w)
        np.add.at(rows, ids, 1.0 / len(ids))
    at = np.flatnonzero(rows)
    return at.astype("<i4").tobytes(), (rows[at] / len(words)).astype("<f4").tobytes()


def sample(docs: DataFrame, bound: int, text_col: str, lang_col: str, key_col: str):
    """Collected rows (language, rows, weights, apart) of at most about ``bound`` labelled texts."""
    labelled = docs.select(
        docs[text_col].alias("text"), docs[lang_col].alias("lang"),
        docs[key_col].alias("key")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    picked = stratified(labelled, "lang", bound, ["key", "text"]).select(
        "text", "lang", (F.pmod(F.xxhash64("text"), F.lit(5)) == 0).alias("apart"))

    def step():
        def one(t):
            out = {"lang": [], "rows": [], "weights": [], "apart": []}
            for text, lang, apart in zip(*(t.column(c).to_pylist() for c in ("text", "lang", "apart")), strict=True):
                if words := words_of(text):
                    rows, weights = _sparse(words)
                    for k, v in (("lang", lang), ("rows", rows), ("weights", weights), ("apart", apart)):
                        out[k].append(v)
            return out

        return one

    return map_slices(picked, step, "lang string, rows binary, weights binary, apart boolean").toPandas()


def fit(
    docs: DataFrame, bound: int = 3000, dim: int = 16, epochs: int = 6, rate: float = 40.0, precision: float = 0.98, seed: int = 7,
    text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id",
) -> Model:
    """Train on at most about ``bound`` rows with a language, chosen by hash and spread evenly over the languages.

    Rows without a text, a letter or a language are skipped; without any row left the
    model knows no language.
    """
    import numpy as np

    got = sample(docs, bound, text_col, lang_col, key_col).sort_values(["lang", "rows", "weights"]).reset_index(drop=True)
    languages = sorted(got["lang"].unique())
    if not languages:
        return Model([], np.zeros((ROWS, 0)), np.zeros(0))
    rows = [np.frombuffer(x, "<i4") for x in got["rows"]]
    weights = [np.frombuffer(x, "<f4").astype("f8") for x in got["weights"]]
    y = np.searchsorted(languages, got["lang"].to_numpy(dtype=object))
    apart = got["apart"].to_numpy(dtype=bool)
    train = np.flatnonzero(~apart) if (~apart).any() else np.arange(len(y))
    rng = np.random.default_rng(seed)
    embed, head, bias = rng.normal(0, 0.1, (ROWS, dim)), rng.normal(0, 0.1, (dim, len(languages))), np.zeros(len(languages))
    steps, done = epochs * len(train), 0
    for _ in range(epochs):
        for i in rng.permutation(train):
            step = rate * (1 - done / steps)
            hidden = weights[i] @ embed[rows[i]]
            error = softmax(hidden @ head + bias)
            error[y[i]] -= 1
            back = head @ error
            head -= step / 100 * np.outer(hidden, error)
            bias -= step / 4000 * error
            embed[rows[i]] -= step / 4 * np.outer(weights[i], back)
            done += 1
    model = Model(languages, embed @ head, bias)
    check = np.flatnonzero(apart) if apart.any() else train
    means = np.array([weights[i] @ model.table[rows[i]] for i in check])
    _calibrate(model, means, y[check], precision)
    return model


def _calibrate(model: Model, means, y, precision: float) -> None:
    """Temperature of least log loss; least score from which predictions reach the precision."""
    import numpy as np

    def loss(t):
        p = softmax((means + model.bias) / t)
        return -np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean()

    grid = np.geomspace(0.05, 20, 61)
    model.temperature = float(grid[int(np.argmin([loss(t) for t in grid]))])
    p = softmax(model.logits(means))
    score, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-score, kind="stable")
    good = np.cumsum(right[order]) / np.arange(1, len(y) + 1) >= precision
    model.accept = float(score[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0


class Words:
    """Language scores of words, remembered in one table per worker; the new words of some texts are scored together."""

    def __init__(self, model: Model):
        import numpy as np

        self.model, self.place = model, {}
        self.table = np.zeros((0, len(model.languages)))

    def _learn(self, new: list[str]) -> None:
        import numpy as np

        ids = [subwords(w) for w in new]
        counts = np.array([len(i) for i in ids])
        flat = np.fromiter(chain.from_iterable(ids), dtype=np.int64, count=int(counts.sum()))
        sums = np.add.reduceat(self.model.table[flat], np.cumsum(counts) - counts, axis=0)
        at = len(self.place)
        if at + len(new) > len(self.table):
            self.table = np.concatenate([self.table[:at], np.zeros((at + len(new) + 4096, sums.shape[1]))])
        self.table[at:at + len(new)] = sums / counts[:, None]
        self.place.update(zip(new, range(at, at + len(new)), strict=True))

    def means(self, texts: list[list[str]]):
        """Mean score of the words of each text; no text may be without words."""
        import numpy as np

        if len(self.place) > REMEMBERED:
            self.place = {}
        if new := list(set().union(*texts).difference(self.place)):
            self._learn(new)
        get = self.place.__getitem__
        out = np.zeros((len(texts), self.table.shape[1]))
        for i, words in enumerate(texts):
            for at in range(0, len(words), REMEMBERED):
                part = np.fromiter(map(get, words[at:at + REMEMBERED]), dtype=np.int64)
                out[i] += self.table[part].sum(axis=0)
            out[i] /= len(words)
        return out


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected: one row per input row, from the text alone.

    A text that is NULL or has no letter, and every text under a model without
    languages, is ``und`` with score 0 and rejected.  ``score`` is the calibrated
    probability of the language named; predictions below the model's accepting score
    are marked rejected, not renamed.  NULL and repeated ids pass through; an empty
    table gives no rows; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # rows x languages numbers, whatever the input
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))

    def step():
        m = sent.value
        words = Words(m)

        def one(t):
            found = [words_of(x) if m.languages else [] for x in t.column("text").to_pylist()]
            langs, scores = [NONE] * len(found), [0.0] * len(found)
            some = [i for i, w in enumerate(found) if w]
            if some:
                p = softmax(m.logits(words.means([found[i] for i in some])))
                for i, best, score in zip(some, p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True):
                    langs[i], scores[i] = m.languages[best], score
            rejected = [x == NONE or y < m.accept for x, y in zip(langs, scores, strict=True)]
            return {"doc_id": t.column("doc_id"), "lang_pred": langs, "score": scores, "rejected": rejected}

        return one

    return map_slices(rows, step, "doc_id bigint, lang_pred string, score double, rejected boolean", rows=256)
