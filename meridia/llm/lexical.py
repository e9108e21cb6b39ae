"""Ranked lexical search: all documents scored for many items at once, shared work done once.

Items are taken in blocks of bounded size.  The documents are read once a block into a
forward index of the block's terms (counts per document).  What items share is mined on
the block: leaves (term, repeats) with the same set of items form one class; then the
pair of sums that most items share becomes a sum of its own, again and again, until no
pair is shared.  That is a DAG of partial accumulators whose sinks are the items.  A task
fills the classes' accumulators for some hundred documents from their postings, adds the
DAG up level by level, each node once, and keeps its k best documents per item; these few
rows are all that is shuffled.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.llm.common import id_and_text, map_slices, partitions, pieces
from meridia.session import durable

#: Bytes of item text in one block, bytes of accumulators a task holds, bytes of text split at once.
BLOCK, ACCUMULATORS, PIECE = 1 << 16, 32 << 20, 1 << 20
#: Nodes of an item among which pairs are mined at a time; bounds the driver's work, not the result.
MINED = 64
#: Maximal runs of digits, letters and code points beyond ASCII are terms; only A-Z are lower-cased.
FOLD = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


def terms(data: bytes):
    """The terms of UTF-8 text in order, lists of a bounded stretch at a time."""
    at = 0
    while at < len(data):
        stop = at + PIECE
        while stop < len(data) and FOLD[data[stop]] != 32:
            stop += 1
        yield data[at:stop].translate(FOLD).split()
        at = stop


def term_counts(text: str | None) -> Counter:
    counts: Counter = Counter()
    for some in terms((text or "").encode()):
        counts.update(some)
    return counts


@dataclass
class Plan:
    """What a block of items shares.

    ``leaf_term``, ``leaf_times``, ``leaf_class``: a class sums its leaves.  Nodes from
    ``classes`` on are the sums of two earlier ones (``left``, ``right``), in levels
    that end at ``levels``; ``items`` lists the nodes of each item.
    """

    leaf_term: list[int]
    leaf_times: list[int]
    leaf_class: list[int]
    classes: int
    left: list[int]
    right: list[int]
    levels: list[int]
    items: list[list[int]]

    @property
    def nodes(self) -> int:
        return self.classes + len(self.left)


def share(queries: list[dict[int, int]]) -> Plan:
    """The plan of items given as {term: repeats}."""
    holders: dict[tuple[int, int], list[int]] = {}
    for i, q in enumerate(queries):
        for leaf in q.items():
            holders.setdefault(leaf, []).append(i)
    class_of: dict[tuple[int, ...], int] = {}
    plan = Plan([], [], [], 0, [], [], [], [[] for _ in queries])
    for (term, times), held in holders.items():
        plan.leaf_term.append(term)
        plan.leaf_times.append(times)
        plan.leaf_class.append(class_of.setdefault(tuple(held), len(class_of)))
    plan.classes = len(class_of)
    users = {c: set(held) for held, c in class_of.items()}
    shared: list[set[int]] = [set() for _ in queries]  # nodes that more than one item has: pairs of them are mined
    for c, held in users.items():
        for i in held:
            (shared[i].add if len(held) > 1 else plan.items[i].append)(c)

    sums: list[tuple[int, int]] = []
    together: dict[tuple[int, int], set[int]] = {}
    for i, nodes in enumerate(shared):
        often = sorted(nodes, key=lambda c: (-len(users[c]), c))
        for at in range(0, len(often), MINED):
            some = sorted(often[at:at + MINED])
            for x, a in enumerate(some):
                for b in some[x + 1:]:
                    together.setdefault((a, b), set()).add(i)
    together = {pair: held for pair, held in together.items() if len(held) > 1}
    heap = [(-len(held), pair) for pair, held in together.items()]
    heapq.heapify(heap)
    while heap:
        n, (a, b) = heapq.heappop(heap)
        held = {i for i in together.get((a, b), ()) if a in shared[i] and b in shared[i]}
        if len(held) < 2:
            continue
        if len(held) < -n:
            together[a, b] = held
            heapq.heappush(heap, (-len(held), (a, b)))
            continue
        node = plan.classes + len(sums)
        sums.append((a, b))
        beside: Counter = Counter()
        for i in held:
            shared[i] -= {a, b}
            beside.update(shared[i])
        for x in (x for x, times in beside.items() if times > 1):
            together[x, node] = {i for i in held if x in shared[i]}
            heapq.heappush(heap, (-len(together[x, node]), (x, node)))
        for i in held:
            shared[i].add(node)
    for i, nodes in enumerate(shared):
        plan.items[i] += sorted(nodes)
    _in_levels(plan, sums)
    return plan


def _in_levels(plan: Plan, sums: list[tuple[int, int]]) -> None:
    """Number the sums so that each level only adds nodes of lower ones."""
    depth = [0] * (plan.classes + len(sums))
    for s, (a, b) in enumerate(sums):
        depth[plan.classes + s] = 1 + max(depth[a], depth[b])
    order = sorted(range(len(sums)), key=lambda s: depth[plan.classes + s])
    new = {c: c for c in range(plan.classes)} | {plan.classes + s: plan.classes + at for at, s in enumerate(order)}
    plan.left, plan.right = ([new[sums[s][side]] for s in order] for side in (0, 1))
    plan.levels = [
        at + 1 for at, s in enumerate(order)
        if at + 1 == len(order) or depth[plan.classes + order[at + 1]] > depth[plan.classes + s]]
    plan.items = [[new[n] for n in nodes] for nodes in plan.items]


def accumulate(plan: Plan, doc, leaf, value, n_docs: int):
    """Accumulators [node, document] from postings (document, leaf, value), every node once."""
    import numpy as np

    acc = np.zeros((plan.nodes, n_docs), dtype=np.int64)
    np.add.at(acc, (np.asarray(plan.leaf_class)[leaf], doc), value)
    left, right, at = np.asarray(plan.left, np.int64), np.asarray(plan.right, np.int64), 0
    for stop in plan.levels:
        acc[plan.classes + at:plan.classes + stop] = acc[left[at:stop]] + acc[right[at:stop]]
        at = stop
    return acc


def _forward(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n terms, and the vocabulary's terms with their counts, of documents that have a term."""

    def step():
        import numpy as np
        import pyarrow as pa

        def lists(rows: list[list[int]]) -> pa.Array:
            ends = np.cumsum([0, *map(len, rows)])
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([x for r in rows for x in r], pa.int32()))

        def one(t):
            kept, n, found, counts = [], [], [], []
            for at, text in enumerate(t.column("text")):
                size, hits = 0, Counter()
                for some in terms(text.as_buffer().to_pybytes()):
                    size += len(some)
                    hits.update(map(vocabulary.get, some))
                if size:
                    hits.pop(None, None)
                    kept.append(at)
                    n.append(size)
                    found.append(list(hits))
                    counts.append(list(hits.values()))
            return {"doc_id": t.column("doc_id").take(pa.array(kept, pa.int64())), "n": n, "terms": lists(found), "counts": lists(counts)}

        return one

    return map_slices(docs, step, "doc_id bigint, n bigint, terms array<int>, counts array<int>")


@dataclass
class Scale:
    """The numbers of the scoring rule that depend on the whole corpus."""

    documents: int
    length: int
    weights: list[int]

    @staticmethod
    def weight(documents: int, holding: int) -> int:
        return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _top(index: DataFrame, plan: Plan, scale: Scale, k: int, b: int) -> DataFrame:
    """item, doc_id, score: at most k rows an item from every task."""
    import pyarrow as pa

    fields = [("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())]
    schema = pa.schema(fields)

    def run(batches):
        import numpy as np

        weights, times = np.asarray(scale.weights, np.int64), np.asarray(plan.leaf_times, np.int64)
        by_term = np.argsort(np.asarray(plan.leaf_term), kind="stable")
        first = np.searchsorted(np.asarray(plan.leaf_term)[by_term], np.arange(len(weights) + 1))
        nodes = [np.asarray(x, np.int64) for x in plan.items]
        rows = max(16, ACCUMULATORS // (8 * max(1, plan.nodes)))
        # the k best so far of each item: score, NULL id last, id
        best = [(np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)) for _ in nodes]
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                t = batch.slice(at, rows)
                n = np.asarray(t.column("n"))
                ids, absent = np.asarray(t.column("doc_id").fill_null(0)), np.asarray(t.column("doc_id").is_null())
                sizes = np.diff(np.asarray(t.column("terms").offsets))
                found, tf = (np.asarray(t.column(c).flatten()).astype(np.int64) for c in ("terms", "counts"))
                doc = np.repeat(np.arange(len(n)), sizes)
                m = 100 - b + (b * n * scale.documents) // scale.length
                gain = weights[found] * ((1000000000 * tf) // (1000 * tf + 8 * m[doc]))
                each = (first[1:] - first[:-1])[found]  # leaves of each posting's term
                posting = np.repeat(np.arange(len(found)), each)
                leaf = by_term[first[found][posting] + np.arange(len(posting)) - (np.cumsum(each) - each)[posting]]
                acc = accumulate(plan, doc[posting], leaf, gain[posting] * times[leaf], len(n))
                for i, mine in enumerate(nodes):
                    score = acc[mine].sum(axis=0)
                    old = best[i]
                    good = np.flatnonzero(score >= (old[0][-1] if len(old[0]) == k else 1))
                    if len(good):
                        s, a, d = (np.concatenate(x) for x in zip(old, (score[good], absent[good], ids[good]), strict=True))
                        order = np.lexsort((d, a, -s))[:k]
                        best[i] = s[order], a[order], d[order]
        for i, (s, a, d) in enumerate(best):
            if len(s):
                columns = [np.full(len(s), i, np.int32), pa.array(d, pa.int64(), mask=a), s]
                yield pa.RecordBatch.from_arrays([pa.array(c, f[1]) for c, f in zip(columns, fields, strict=True)], schema=schema)

    return index.mapInArrow(run, "item int, doc_id bigint, score bigint")


def _ranked(hits: DataFrame, k: int, *key: Column) -> DataFrame:
    w = Window.partitionBy("item", *key).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = 10, b: int = 75, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item, scores above 0 only.

    A term found tf times in a document of n terms adds, for each of its occurrences in
    the item, w * ((10**9 * tf) div (1000 * tf + 8 * m)), with m = 100 - b + (b * n * N) div L
    and w = floor(1000 * ln((2N + 2) / (2df + 1))).  N, L and df count all documents that
    have a term; equal scores come by ascending doc_id, NULL last.

    Rows of one doc_id are documents of their own, repeated rows too.  NULL and empty
    texts have no terms; texts of any length are read in stretches.  Rows of one item_id
    are items of their own, ranked apart; an item repeated as a whole gets its rows once
    for each repeat; a NULL item_id is an id like any other.  Empty tables give no rows;
    other columns are ignored.
    """
    spark = docs.sparkSession
    base = id_and_text(docs, id_col, text_col)
    asked = items.select(items[item_col].alias("item_id"), F.coalesce(items[item_text], F.lit("")).alias("text"))
    asked = asked.groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, found = pieces(size, BLOCK, 1), None
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = mine.collect()  # about BLOCK bytes of text
        counts = [term_counts(r["text"]) for r in rows]
        vocabulary = {t: at for at, t in enumerate(sorted(set().union(*counts)))}
        plan = share([{vocabulary[t]: n for t, n in c.items()} for c in counts])
        index = durable(_forward(base, vocabulary), "forward")
        n_docs, length = index.agg(F.count(F.lit(1)), F.sum("n")).first()
        held = index.select(F.explode("terms").alias("term")).groupBy("term").count()
        df = {r["term"]: r["count"] for r in held.collect()}  # the block's terms at most
        scale = Scale(n_docs, length or 1, [Scale.weight(n_docs, df.get(t, 0)) for t in range(len(vocabulary))])
        hits = _top(index.where(F.size("terms") > 0), plan, scale, k, b)
        # many tasks give k rows an item each: cut in two steps, so that no item meets in one task at once
        lots = F.pmod(F.xxhash64("doc_id"), F.lit(max(2, math.isqrt(partitions(spark)))))
        top = _ranked(_ranked(hits.withColumn("lot", lots), k, F.col("lot")).drop("lot", "rank"), k)
        names = spark.createDataFrame(
            [(at, r["item_id"], r["copies"]) for at, r in enumerate(rows)], f"item int, item_id {asked.schema['item_id'].dataType.simpleString()}, copies bigint")
        part = top.join(names, "item").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        part = part.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        found = part if found is None else found.unionByName(part)
    return found
