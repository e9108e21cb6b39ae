"""MinHash near-dedup with sequential Bayesian verification.

1. Every text becomes its set of word shingles; texts with equal sets form one node.
2. Nodes get MinHash signatures; nodes agreeing on a whole band of values share a bucket.
3. A candidate pair is compared batch by batch of signature values.  After each batch the
   posterior of the similarity (uniform prior) is known from the matches so far; the pair
   is dropped when the probability of reaching the threshold falls below ``miss``.
4. Survivors are verified on their full sets, and links joined into components.

Candidates are taken in two steps, so that large groups never become all pairs.  First
each bucket's members meet its least member: as many pairs as rows.  The links found
join most groups.  Then only buckets whose other members still belong to different
components are searched in full, in square tiles of bounded size, for pairs across
components.  A tile brings its members' full sets along, verifies its survivors itself
and returns only links that join components, fewer than it has members.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.llm.common import Stages, map_slices, sweep
from meridia.llm.graph import components
from meridia.session import durable

BANDS, BAND_ROWS, MISS, TILE, COLUMNS = 29, 5, 1e-5, 1024, 8192


def least_matches(n: int, threshold: float, miss: float) -> int:
    """Fewest matches among ``n`` values at which P(similarity >= threshold) is still ``miss`` or more.

    With a uniform prior that probability is the chance of at most m successes in n + 1
    trials of probability ``threshold``.
    """
    total = 0.0
    for m in range(n + 1):
        total += math.exp(
            math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m)
            + m * math.log(threshold) + (n + 1 - m) * math.log1p(-threshold)) if threshold < 1 else 0.0
        if total >= miss:
            return m
    return n


def _bounds(bands: int, rows: int, threshold: float, miss: float) -> list[tuple[int, int, int]]:
    """(start, end, least matches by then) of each batch: one value of every band at a time.

    The bound is a posterior probability, not a miss rate.  Each batch gets an equal part of
    ``miss`` and is lowered until all together drop a pair just at the threshold at most that often.
    """
    least = [least_matches((i + 1) * bands, threshold, miss / rows) for i in range(rows)]
    while drop_rate(bands, least, threshold) > miss and any(least):
        least = [max(m - 1, 0) for m in least]
    return [(i * bands, (i + 1) * bands, m) for i, m in enumerate(least)]


def drop_rate(bands: int, least: list[int], similarity: float) -> float:
    """Chance that a pair with independent matches falls below ``least`` after any batch of ``bands`` values."""
    one = [math.comb(bands, k) * similarity ** k * (1 - similarity) ** (bands - k) for k in range(bands + 1)]
    alive = [1.0]
    lost = 0.0
    for m in least:
        after = [0.0] * (len(alive) + bands)
        for i, a in enumerate(alive):
            for k, b in enumerate(one):
                after[i + k] += a * b
        lost += sum(after[:m])
        alive = [0.0] * m + after[m:]
    return lost


def _sketch_step(shingle: int, values: int):
    def step():
        import numpy as np

        from meridia.llm.wordhash import U, mix, shingle_sets

        a = mix(np.arange(1, values + 1, dtype=U)) | U(1)
        b = mix(np.arange(10_001, 10_001 + values, dtype=U))

        def one(t):
            sets = shingle_sets(t.column("text").to_pylist(), shingle)
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            full = np.flatnonzero(sizes)
            signature = np.zeros((len(full), values), dtype="<u4")
            if len(full):
                flat, cuts = np.concatenate([sets[i] for i in full]), np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                for i in range(values):
                    signature[:, i] = np.minimum.reduceat((flat * a[i] + b[i]) >> U(32), cuts)
            rows = iter(signature)
            return {
                "doc_id": t.column("doc_id"), "row": t.column("row"), "n": sizes,
                "node": [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets],
                "signature": [next(rows).tobytes() if n else None for n in sizes]}

        return one

    return step


def _band_step(bands: int, rows: int):
    """Buckets of nodes: band j holds the values j, j + bands, j + 2 * bands, ..."""

    def step():
        import numpy as np

        from meridia.llm.wordhash import U, mix

        def one(t):
            sig = np.frombuffer(b"".join(t.column("signature").to_pylist()), "<u4").reshape(-1, rows, bands)
            key = np.tile(mix(np.arange(1, bands + 1, dtype=U)), (len(sig), 1))
            for r in range(rows):
                key = mix(key ^ sig[:, r, :].astype(U)) * U(0x9E3779B97F4A7C15)
            return {"node": t.column("node"), "bands": list(key.view(np.int64))}

        return one

    return step


def _pass(left, right, bounds):
    """Indices of the pairs of signature rows that no batch drops."""
    import numpy as np

    alive, found = np.arange(len(left)), np.zeros(len(left), dtype=np.int64)
    for a, b, least in bounds:
        found = found + (left[alive, a:b] == right[alive, a:b]).sum(axis=1)
        keep = found >= least
        alive, found = alive[keep], found[keep]
    return alive


def _matrix(column):
    import numpy as np

    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<u4").reshape(len(rows), -1) if rows else np.zeros((0, 1), "<u4")


def _screened(pairs: DataFrame, nodes: DataFrame, bounds, low: float) -> DataFrame:
    """The pairs (a, b) that size and signatures leave possible."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("signature").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where(F.least("n_a", "n_b") >= F.lit(low) * F.greatest("n_a", "n_b"))

    def step():
        def one(t):
            keep = _pass(_matrix(t.column("s_a")), _matrix(t.column("s_b")), bounds)
            return {c: t.column(c).take(keep) for c in ("a", "b")}

        return one

    return map_slices(both.select("a", "b", "s_a", "s_b"), step, "a binary, b binary", rows=2048)


def _sets(wanted: DataFrame, nodes: DataFrame, base: DataFrame, shingle: int, store) -> DataFrame:
    """(node, members): the full shingle sets of some nodes, as sorted 64-bit hashes."""
    places = nodes.join(wanted, "node").select("node", F.col("rep.doc_id").alias("r_id"), F.col("rep.row").alias("r_row"))
    at = base["doc_id"].eqNullSafe(places["r_id"]) & (base["row"] == places["r_row"])
    texts = base.join(places, at).select("node", "text")

    def make():
        from meridia.llm.wordhash import shingle_sets

        return lambda t: {"node": t.column("node"), "members": [s.tobytes() for s in shingle_sets(t.column("text").to_pylist(), shingle)]}

    return store(map_slices(texts, make, "node binary, members binary"), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int, store) -> DataFrame:
    """The pairs whose full sets reach the threshold ``num / den``."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("members").alias(f"m_{x}"))

    def compare():
        import numpy as np

        def one(t):
            keep = []
            for i, (x, y) in enumerate(zip(t.column("m_a").to_pylist(), t.column("m_b").to_pylist(), strict=True)):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                common = len(np.intersect1d(x, y, assume_unique=True))
                if den * common >= num * (len(x) + len(y) - common):
                    keep.append(i)
            return {c: t.column(c).take(np.array(keep, dtype=np.int64)) for c in ("a", "b")}

        return one

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "m_a", "m_b")
    return store(map_slices(both, compare, "a binary, b binary", rows=256).distinct(), "links")


def _common(sets: list):
    """Sizes of the intersections of all pairs of sets, a bounded stretch of distinct members at a time."""
    import numpy as np

    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = (np.cumsum(times > 1) - 1)[place]  # members of one set only are common to no pair
    shared = times[place] > 1
    owner, column = owner[shared], column[shared]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.int64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        x, y = np.searchsorted(column, [at, at + COLUMNS])
        has = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        has[owner[x:y], column[x:y] - at] = 1
        out += (has @ has.T).astype(np.int64)
    return out


def _tile_search(bounds, low: float, num: int, den: int):
    """Verified links across components within one tile of a bucket, a spanning forest of them."""

    def run(t):
        import numpy as np
        import pyarrow as pa

        t = t.sort_by("node")
        node, root = t.column("node").to_pylist(), t.column("root").to_pylist()
        names = {r: i for i, r in enumerate(dict.fromkeys(root))}
        group, size, tile = np.array([names[r] for r in root]), np.asarray(t.column("n")), np.asarray(t.column("tile"))
        sig, apart = _matrix(t.column("signature")), t.column("i")[0].as_py() != t.column("j")[0].as_py()
        left, right = [], []
        for x in range(1, len(node)):
            ok = (group[:x] != group[x]) & (np.minimum(size[:x], size[x]) >= low * np.maximum(size[:x], size[x]))
            if apart:
                ok &= tile[:x] != tile[x]
            y = np.flatnonzero(ok)
            y = y[_pass(sig[y], np.broadcast_to(sig[x], (len(y), sig.shape[1])), bounds)]
            left.append(y)
            right.append(np.full(len(y), x))
        left, right = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (left, right))
        out = []
        if len(left):
            rows, place = np.unique(np.concatenate([left, right]), return_inverse=True)
            members = t.column("members").take(rows).to_pylist()
            common = _common([np.frombuffer(m, "<u8") for m in members])[place[:len(left)], place[len(left):]]
            linked = den * common >= num * (size[left] + size[right] - common)
            up = list(range(len(names)))

            def top(g):
                while up[g] != g:
                    up[g] = up[up[g]]
                    g = up[g]
                return g

            for x, y in zip(left[linked].tolist(), right[linked].tolist(), strict=True):
                a, b = top(group[x]), top(group[y])
                if a != b:
                    up[a] = b
                    out.append((node[x], node[y]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([y for _, y in out], pa.binary())})

    return run


def near_duplicates(
    docs: DataFrame, shingle: int = 5, threshold: float = 0.8, bands: int = BANDS, rows: int = BAND_ROWS, miss: float = MISS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, row, n_shingles, component_id, kept: one row per input row; ``row`` is a hash of the text.

    Two texts are linked if the Jaccard similarity of their sets of ``shingle``-word runs
    (A-Z lower-cased; all words as one run if there are fewer) reaches ``threshold``, found
    with a chance of missing a pair just at it of (1 - threshold ** rows) ** bands + miss.
    component_id is the least doc_id of the component; kept says whether it is the row's own.

    NULL and empty texts have no set, are linked with nothing and kept.  A NULL doc_id
    counts as no id: it names a component only if there is no other in it.  Rows repeated
    under one doc_id are one document.  An empty table gives no rows; other columns are ignored.
    """
    bounds = _bounds(bands, rows, threshold, miss)
    text = F.coalesce(docs[text_col], F.lit(""))
    base = docs.select(docs[id_col].cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("row"))
    sketches = durable(map_slices(
        base, _sketch_step(shingle, bands * rows), "doc_id bigint, row bigint, n bigint, node binary, signature binary"), "sketches")
    stages = Stages(docs.sparkSession)
    store = stages.keep
    nodes = store(sketches.where("n > 0").groupBy("node").agg(
        F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "row")).alias("rep"),
        F.first("n").alias("n"), F.first("signature").alias("signature")), "nodes")
    buckets = map_slices(nodes.select("node", "signature"), _band_step(bands, rows), "node binary, bands array<bigint>")
    buckets = store(buckets.select("node", F.explode("bands").alias("band")), "buckets")
    shared = store(
        buckets.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("pivot")).where("size > 1"), "shared")
    low = threshold - 1e-9
    members = store(
        buckets.join(shared, "band").where(F.col("node") != F.col("pivot")).select("band", "size", "node", "pivot"), "members")
    pairs = members.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    num, den = round(threshold * 10_000), 10_000
    survivors = store(_screened(pairs, nodes, bounds, low), "survivors")
    crowded = members.where("size > 2")
    wanted = reduce(DataFrame.unionByName, [survivors.select(F.col("a").alias("node")), survivors.select(F.col("b").alias("node")), crowded.select("node")])
    sweep(docs.sparkSession)
    sets = _sets(wanted.distinct(), nodes, base, shingle, store)
    links = _verified(survivors, sets, num, den, store)
    roots = store(components(links, store), "roots")
    sweep(docs.sparkSession)
    placed = crowded.join(roots, "node", "left").select("band", "size", "node", F.coalesce("root", "node").alias("root"))
    open_ = placed.groupBy("band").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("band")
    ways = F.ceil(F.col("size") / F.lit(TILE)).cast("int")
    tiled = (
        placed.join(store(open_, "open"), "band").join(nodes.select("node", "n", "signature"), "node").join(sets, "node")
        .withColumn("tile", F.pmod(F.xxhash64("node"), ways).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), ways - 1)))
        .select("band", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"),
                "tile", "node", "root", "n", "signature", "members"))
    found = tiled.groupBy("band", "i", "j").applyInArrow(_tile_search(bounds, low, num, den), "a binary, b binary")
    roots = store(components(store(links.unionByName(found), "links"), store), "roots")
    rooted = nodes.select("node", "least_id").join(roots, "node", "left").select(
        "node", "least_id", F.coalesce("root", "node").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    ids = durable(rooted.join(named, "root").select("node", "component_id"), "components")
    sweep(docs.sparkSession)
    stages.drop()  # what is left to read are the sketches and these
    out = sketches.select("doc_id", "row", "n", "node").join(ids, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id", "row", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns only."""
    kept = near_duplicates(docs, id_col=id_col, text_col=text_col, **how).where("kept").select(
        F.col("doc_id").alias("k_id"), F.col("row").alias("k_row")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("k_doc"), docs[id_col].cast("bigint").alias("d_id"),
                       F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("d_row"))
    same = F.col("d_id").eqNullSafe(F.col("k_id")) & (F.col("d_row") == F.col("k_row"))
    return rows.join(kept, same, "left_semi").select("k_doc.*")
