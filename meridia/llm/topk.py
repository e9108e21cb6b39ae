"""Exact top-k by inner product: a KD-tree per shard, searched best first.

Rows are dealt to cells of space by the top splits of a tree of medians, fitted on a
bounded sample (at most ``PER_CELL`` rows a cell); every row is dealt, and a cell of
many rows is cut into shards by a hash, so equal vectors spread.  Each shard is packed
into one stored row.  A shard's own tree splits by position at the median of the widest
side and keeps the tight box of every node.  A box bounds the inner product of anything
inside it from above; nodes are taken by falling bound until the bound is below the
k-th score.  Each query is first answered in its own shard, without a shuffle.  Its k-th
score there is then compared with the exact boxes of all cells, and only the pairs of
query and cell whose bound reaches it travel.  Query blocks have a fixed size, so a
task holds one shard and one block, whatever the number of queries.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.llm.common import partitions
from meridia.session import durable

SHARD, BLOCK, LEAF = 8192, 4096, 128
#: Levels of the tree of cells at most, its sample in rows a cell and in numbers, queries routed at once.
DEPTH, PER_CELL, SAMPLE_DOUBLES, ROUTE = 12, 16, 1 << 22, 1024
LONG = 1 << 63
KEY = ["dim", "cell", "part"]
PACKED = ("dim int, cell int, part int, ids binary, hashes binary, points binary, low array<double>, high array<double>")
ASKED = ("dim int, home_cell int, home_part int, query_id bigint, q_hash bigint, v array<double>, floor bigint, "
         "vec_ids array<bigint>, scores array<bigint>")
HITS = "query_id bigint, q_hash bigint, vec_id bigint, score bigint"


def quantized(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as double (exact up to 2**53)."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))


def usable(vector: Column) -> Column:
    """Neither NULL nor holding NULL or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


class Tree:
    """KD-tree over the rows of a matrix; nodes are (box, children or rows)."""

    def __init__(self, points, ids):
        import numpy as np

        self.points, self.ids = points, ids
        self.low, self.high, self.kids, self.rows = [], [], [], []
        self._grow(np.arange(len(ids)))
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _grow(self, rows) -> int:
        import numpy as np

        mine = self.points[rows]
        at = len(self.kids)
        self.low.append(mine.min(axis=0))
        self.high.append(mine.max(axis=0))
        self.kids.append(None)
        self.rows.append(rows)
        if len(rows) > LEAF and mine.shape[1]:
            side = int(np.argmax(self.high[at] - self.low[at]))
            half = len(rows) // 2
            order = np.argpartition(mine[:, side], half)
            self.rows[at] = None
            self.kids[at] = (self._grow(rows[order[:half]]), self._grow(rows[order[half:]]))
        return at

    def search(self, query, own: int, k: int, floor: int | None, exact):
        """Up to k (score, id), best first, ties to the smaller id; scores below ``floor`` are left out."""
        import heapq

        import numpy as np

        up, down = np.maximum(query, 0), np.minimum(query, 0)
        bound = lambda n: float(self.high[n] @ up + self.low[n] @ down)
        slack = 0.0 if exact is np.matmul else abs(query) @ np.maximum(abs(self.low[0]), abs(self.high[0])) * 1e-9
        best: list[tuple[int, int]] = []
        todo = [(-bound(0), 0)]
        while todo:
            most, node = heapq.heappop(todo)
            if floor is not None and floor > -LONG and -most + slack < floor:
                break
            if self.kids[node]:
                for kid in self.kids[node]:
                    heapq.heappush(todo, (-bound(kid), kid))
                continue
            rows = self.rows[node]
            scores, ids = exact(self.points[rows], query), self.ids[rows]
            good = ids != own
            if floor is not None:
                good &= scores >= floor
            if good.any():
                scores, ids = scores[good], ids[good]
                first = np.lexsort((ids, -scores))[:k]
                best = sorted([*best, *((int(scores[i]), int(ids[i])) for i in first)], key=lambda x: (-x[0], x[1]))[:k]
                if len(best) == k:
                    floor = best[-1][0] if floor is None else max(floor, best[-1][0])
        return best


def _product(points, queries):
    """Inner products without rounding: doubles while they are exact, whole numbers of any size beyond."""
    import numpy as np

    most = float(abs(points).max(initial=0)) * float(abs(queries).max(initial=0)) * points.shape[1]
    if most < 2**53:
        return np.matmul
    limits = lambda s: max(-LONG, min(LONG - 1, s))
    return lambda p, q: np.array([limits(sum(int(a) * int(b) for a, b in zip(r, q, strict=True))) for r in p], dtype=object)


def _matrix(column, n: int, dim: int):
    """Rows of equally long lists as a matrix."""
    import numpy as np

    return np.asarray(column.combine_chunks().flatten(), dtype="<f8").reshape(n, dim)


def _splits(vectors: DataFrame, n: int, depth: int) -> tuple[list[int], list[float]]:
    """Side and cut of each inner node of a complete tree of medians; node i has the children 2i+1 and 2i+2."""
    import numpy as np

    dim = vectors.agg(F.max("dim")).first()[0] or 1
    most = min(PER_CELL << depth, max(1, SAMPLE_DOUBLES // dim))
    scale = 1 << 30
    share = min(scale, math.ceil(1.25 * scale * most / max(n, 1)))
    picked = vectors.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(scale)) < share).select("v").limit(most).toArrow()
    points = np.zeros((picked.num_rows, dim))
    for i, row in enumerate(picked.column("v")):
        points[i, :len(row)] = row.values.to_numpy(zero_copy_only=False)
    sides, cuts, groups = [], [], {0: points}
    for node in range((1 << depth) - 1):
        mine = groups.pop(node)
        side, cut = 0, 0.0
        if len(mine):
            side = int(np.argmax(np.ptp(mine, axis=0)))
            cut = float(np.sort(mine[:, side])[len(mine) // 2])
        above = mine[:, side] >= cut
        groups[2 * node + 1], groups[2 * node + 2] = mine[~above], mine[above]
        sides.append(side)
        cuts.append(cut)
    return sides, cuts


def _cell(v: Column, sides: list[int], cuts: list[float], depth: int) -> Column:
    """The leaf a vector falls into; components beyond its length count as 0."""
    if not depth:
        return F.lit(0)
    side, cut = F.lit(sides), F.lit(cuts)

    def down(node, _):
        above = F.coalesce(F.get(v, F.get(side, node)), F.lit(0.0)) >= F.get(cut, node)
        return node * 2 + F.when(above, 2).otherwise(1)

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), down) - len(sides)


def _pack(k: int):
    """A shard as one row, with its box; of equal rows more than k are never needed."""

    def run(key, table):
        import numpy as np
        import pyarrow as pa

        dim, cell, part = (x.as_py() for x in key)
        times = np.minimum(np.asarray(table.column("copies")), k)
        points = np.repeat(_matrix(table.column("v"), table.num_rows, dim), times, axis=0)
        ids, hashes = (np.repeat(np.asarray(table.column(c)).astype("<i8"), times) for c in ("vec_id", "q_hash"))
        row = {"dim": dim, "cell": cell, "part": part, "ids": ids.tobytes(), "hashes": hashes.tobytes(),
               "points": points.tobytes(), "low": points.min(axis=0).tolist(), "high": points.max(axis=0).tolist()}
        whole, box = pa.int32(), pa.list_(pa.float64())
        types = [whole, whole, whole, pa.binary(), pa.binary(), pa.binary(), box, box]
        return pa.table({c: pa.array([x], t) for (c, x), t in zip(row.items(), types, strict=True)})

    return run


def _unpacked(row: dict):
    import numpy as np

    ids = np.frombuffer(row["ids"], "<i8")
    return ids, np.frombuffer(row["points"], "<f8").reshape(len(ids), row["dim"])


def _home(k: int, every: int):
    """The queries among a shard's own rows, answered there."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ASKED))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                ids, points = _unpacked(row)
                hashes, out = np.frombuffer(row["hashes"], "<i8"), []
                rows = np.flatnonzero(ids % every == 0)
                if not len(rows):
                    continue
                tree, exact = Tree(points, ids), _product(points, points[rows])
                for i in {(int(ids[i]), int(hashes[i])): int(i) for i in rows}.values():
                    found = tree.search(points[i], ids[i], k, None, exact)
                    out.append({
                        "dim": row["dim"], "home_cell": row["cell"], "home_part": row["part"], "query_id": int(ids[i]),
                        "q_hash": int(hashes[i]), "v": points[i].tolist(), "floor": found[-1][0] if len(found) == k else None,
                        "vec_ids": [v for _, v in found], "scores": [s for s, _ in found]})
                    if len(out) == BLOCK:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out = []
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _reached(key, boxes, asked):
    """The pairs of a query and a cell whose bound reaches the query's floor."""
    import numpy as np
    import pyarrow as pa

    dim, pairs = key[0].as_py(), []
    if boxes.num_rows and asked.num_rows:
        low, high = (_matrix(boxes.column(c), boxes.num_rows, dim) for c in ("low", "high"))
        cells, queries = np.asarray(boxes.column("cell")), _matrix(asked.column("v"), asked.num_rows, dim)
        widest = np.maximum(abs(low), abs(high))
        most = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T + 1e-9 * (abs(queries) @ widest.T)
        floor = np.array([-np.inf if f is None or f <= -LONG else float(f) for f in asked.column("floor").to_pylist()])
        at, cell = np.nonzero(most >= floor[:, None])
        pairs = [np.full(len(at), dim, "i4"), cells[cell], *(np.asarray(asked.column(c))[at] for c in ("query_id", "q_hash"))]
    types = (pa.int32(), pa.int32(), pa.int64(), pa.int64())
    return pa.table({c: pa.array(x, t) for c, x, t in zip(
        ("dim", "cell", "query_id", "q_hash"), pairs or [[]] * 4, types, strict=True)})


def routed(boxes: DataFrame, asked: DataFrame) -> DataFrame:
    """dim, cell, query_id, q_hash: the cells each query must visit, by the exact boxes (dim, cell, low, high)."""
    blocks = max(1, math.ceil(asked.count() / ROUTE))
    each = boxes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    block = F.pmod(F.xxhash64("query_id", "q_hash"), F.lit(blocks)).cast("int")
    queries = asked.select("dim", "query_id", "q_hash", "v", "floor", block.alias("block"))
    return each.groupBy("dim", "block").cogroup(queries.groupBy("dim", "block")).applyInArrow(
        _reached, "dim int, cell int, query_id bigint, q_hash bigint")


def cell_boxes(packed: DataFrame) -> DataFrame:
    """dim, cell, low, high: the tight box of each cell, from those of its shards."""
    sides = packed.select("dim", "cell", F.posexplode_outer(F.arrays_zip("low", "high")).alias("pos", "side"))
    ends = sides.groupBy("dim", "cell", "pos").agg(F.min("side.low").alias("low"), F.max("side.high").alias("high"))
    box = ends.groupBy("dim", "cell").agg(F.sort_array(F.collect_list(
        F.when(F.col("pos").isNotNull(), F.struct("pos", "low", "high")))).alias("box"))
    return box.select("dim", "cell", F.col("box.low").alias("low"), F.col("box.high").alias("high"))


def _search(k: int):
    """Answers of a block of queries among a shard's rows."""

    def run(left, right):
        import numpy as np
        import pyarrow as pa

        out = []
        for row in left.to_pylist() if right.num_rows else []:
            ids, points = _unpacked(row)
            queries = _matrix(right.column("v"), right.num_rows, row["dim"])
            tree, exact = Tree(points, ids), _product(points, queries)
            asked, hashes, floors = (right.column(c).to_pylist() for c in ("query_id", "q_hash", "floor"))
            for q, own, h, floor in zip(queries, asked, hashes, floors, strict=True):
                out += [(own, h, v, s) for s, v in tree.search(q, own, k, floor, exact)]
        cols = list(zip(*out, strict=True)) or [[]] * 4
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "q_hash", "vec_id", "score"), cols, strict=True)})

    return run


def _best(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits of each query with their rank."""
    w = Window.partitionBy("query_id", "q_hash").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(
    rows: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every``, its k best other rows.

    Rows with a NULL id or an unusable vector (NULL, or with NULL or non-finite
    components) take no part; vectors are compared with those of the same length,
    empty ones score 0.  Rows sharing the query's id are not its candidates.  Rows
    repeated under another id or the same one are all candidates; a query repeated as
    a whole is asked once.  Scores beyond 64 bits stop at the limit.  An empty table
    gives no rows; other columns are ignored.
    """
    spark = rows.sparkSession
    vectors = rows.select(rows[id_col].cast("bigint").alias("vec_id"), rows[vector_col].alias("raw"))
    vectors = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("raw"))).select(
        "vec_id", quantized(F.col("raw"), scale).alias("v"), F.size("raw").alias("dim"))
    points = durable(vectors.groupBy("dim", "vec_id", "v").agg(F.count(F.lit(1)).alias("copies")), "points")
    n = points.count()
    depth = min(DEPTH, math.ceil(math.log2(max(partitions(spark), n / SHARD, 1))))
    placed = points.withColumn("cell", _cell(F.col("v"), *_splits(points, n, depth), depth))
    parts = durable(placed.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("parts")), "parts")
    dealt = placed.join(parts, ["dim", "cell"]).withColumn("q_hash", F.xxhash64("v")).withColumn(
        "part", F.pmod(F.xxhash64("vec_id", "q_hash"), F.col("parts")).cast("int"))
    packed = durable(dealt.groupBy(*KEY).applyInArrow(_pack(k), PACKED), "shards")
    asked = durable(packed.mapInArrow(_home(k, every), ASKED), "queries")

    pairs = routed(cell_boxes(packed), asked).join(parts, ["dim", "cell"]).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    away = durable(pairs.select(*KEY, "query_id", "q_hash").join(
        asked.select(*(F.col(c).alias(a) for c, a in zip(("dim", "home_cell", "home_part"), KEY, strict=True)), "query_id", "q_hash"),
        [*KEY, "query_id", "q_hash"], "left_anti"), "away")
    load = away.groupBy(*KEY).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    sent = (
        away.join(load, KEY).withColumn("block", F.pmod(F.xxhash64("query_id", "q_hash"), F.col("blocks")).cast("int"))
        .join(asked.select("query_id", "q_hash", "v", "floor"), ["query_id", "q_hash"]))
    shards = packed.select(*KEY, "ids", "points").join(load, KEY).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    far = shards.groupBy(*KEY, "block").cogroup(
        sent.select(*KEY, "block", "query_id", "q_hash", "v", "floor").groupBy(*KEY, "block")).applyInArrow(_search(k), HITS)
    near = asked.select("query_id", "q_hash", F.explode(F.arrays_zip("vec_ids", "scores")).alias("hit")).select(
        "query_id", "q_hash", F.col("hit.vec_ids").alias("vec_id"), F.col("hit.scores").alias("score"))
    return _best(near.unionByName(far), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
