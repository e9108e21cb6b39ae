"""Substring dedup: repeated passages stay where they start first.

Fixed-block anchors.  A passage of ``window`` words that occurs twice contains, at its
first occurrence, a whole block of half that length at a multiple of the block length.
So only non-overlapping blocks are indexed, every rolling window of block length probes
the index, and each hit is extended to the maximal repeat: all window starts whose window
covers the hit are looked up by a 128-bit hash of their words, the earliest keeps.

Documents are dealt into chunks of a few MB by a hash.  A chunk reduces its rolling hashes
to distinct ones, cut into ranges ("buckets") and packed as arrays, so a passage that a
third of all documents share arrives at its bucket once per chunk, and rows are arrays,
not windows.  Answers come back as one bit per packed entry, and the chunk, which can
form the same arrays again, applies them to its positions:

    chunk -> (bucket, chunk, distinct block-length hashes) -> bits: hits an indexed block
    chunk + bits -> (bucket, chunk, distinct window hashes around hits) -> bits: starts earlier elsewhere
    chunk + bits -> text without covered words

The texts are shuffled once; the three steps read the same exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.llm.common import partitions, pieces

CHUNK_BYTES, BUCKET_WORDS, WORD_BYTES = 8 << 20, 1 << 20, 6
FIRST = "bucket int, chunk bigint, hashes binary, repeated binary, blocks binary"
SECOND = "bucket int, chunk bigint, h1 binary, h2 binary, doc binary, ids binary, rows binary"
BITS = "chunk bigint, kind int, bucket int, bits binary"


def _rows(table):
    """The chunk's rows in the order that decides which start is earlier: NULL id first, then by text hash."""
    import numpy as np

    ids = table.column("doc_id").to_pylist()
    known = np.array([i if i is not None else -(1 << 63) for i in ids], dtype=np.int64)
    row = np.asarray(table.column("row"))
    order = np.lexsort((row, np.array([i is not None for i in ids]), known))
    texts = table.column("text").to_pylist()
    return [ids[i] for i in order], known[order], row[order], [texts[i] for i in order]


class Chunk:
    """Hashes of a chunk's rolling windows, the same whenever they are formed."""

    def __init__(self, table, window: int):
        import numpy as np

        from meridia.llm.wordhash import Words

        self.window, self.block = window, (window + 1) // 2
        self.ids, self.known, self.row, self.texts = _rows(table)
        self.words = Words(self.texts)
        hashes, self.at, text = self.words.runs(self.block)
        self.distinct, self.place = np.unique(hashes, return_inverse=True)
        self.is_block = (self.at - self.words.first[text]) % self.block == 0

    def anchors(self, bits: int):
        """Packed rows of the distinct block-length hashes, one per bucket."""
        import numpy as np

        n = len(self.distinct)
        repeated = np.bincount(self.place, minlength=n) > 1
        block = np.bincount(self.place[self.is_block], minlength=n) > 0
        buckets, cuts = _cuts(self.distinct, bits)
        low = ((self.distinct << np.uint64(bits)) >> np.uint64(32)).astype("<u4")
        for b, x, y in zip(buckets, cuts[:-1], cuts[1:], strict=True):
            yield int(b), low[x:y].tobytes(), np.packbits(repeated[x:y]).tobytes(), np.packbits(block[x:y]).tobytes()

    def candidates(self, bits: int, hits: dict[int, bytes]):
        """Window starts near hits: (h1, h2, word index, text), in order of h1, h2 and place."""
        import numpy as np

        from meridia.llm.wordhash import U, mix

        hit = _spread(self.distinct, bits, hits)
        flag = np.zeros(len(self.words.hashes) + 1, dtype=np.int64)
        flag[self.at[hit[self.place]]] = 1
        seen = np.concatenate([[0], np.cumsum(flag)])
        h1, at, text = self.words.runs(self.window)
        near = seen[at + self.window - self.block + 1] > seen[at]
        h1, at, text = h1[near], at[near], text[near]
        h2 = np.zeros(len(at), dtype=U)
        for i in range(self.window):
            h2 = mix(h2 * U(0x9FB21C651E98DF25) + self.words.hashes[at + i])
        order = np.lexsort((at, h2, h1))
        return h1[order], h2[order], at[order], text[order]


def _cuts(hashes, bits: int):
    """Buckets (upper ``bits`` bits) that occur in sorted hashes, and where each begins and the last ends."""
    import numpy as np

    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    begins = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    return bucket[begins], np.concatenate([begins, [len(bucket)]])


def _spread(hashes, bits: int, answers: dict[int, bytes]):
    """One flag per sorted hash from the answers by bucket."""
    import numpy as np

    out = np.zeros(len(hashes), dtype=bool)
    buckets, cuts = _cuts(hashes, bits)
    for b, x, y in zip(buckets, cuts[:-1], cuts[1:], strict=True):
        if got := answers.get(int(b)):
            out[x:y] = np.unpackbits(np.frombuffer(got, np.uint8), count=y - x)
    return out


def _runs_first(h1, h2):
    """Where each distinct (h1, h2) of sorted pairs begins."""
    import numpy as np

    if not len(h1):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]))


def _table(schema_of: str, columns: list):
    import pyarrow as pa

    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema_of.split(", "))])
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _column(rows: list, n: int):
    return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(n)]


def _index(window: int, bits: int):
    def run(table):
        number = table.column("chunk")[0].as_py()
        return _table(FIRST, _column([(b, number, h, r, k) for b, h, r, k in Chunk(table, window).anchors(bits)], 5))

    return run


def _probe(table):
    """Which entries of a bucket hold a window that occurs twice, once or more as an indexed block."""
    import numpy as np

    hashes = [np.frombuffer(x, "<u4") for x in table.column("hashes").to_pylist()]
    flags = lambda c: np.concatenate([
        np.unpackbits(np.frombuffer(x, np.uint8), count=len(h)).astype(bool)
        for x, h in zip(table.column(c).to_pylist(), hashes, strict=True)])
    _, place = np.unique(np.concatenate(hashes), return_inverse=True)
    times = np.bincount(place) + np.bincount(place, flags("repeated"))
    hit = ((times > 1) & (np.bincount(place, flags("blocks")) > 0))[place]
    return _answers(table, 0, np.split(hit, np.cumsum([len(h) for h in hashes])[:-1]))


def _answers(table, kind: int, flags: list):
    import numpy as np

    where = zip(table.column("chunk").to_pylist(), table.column("bucket").to_pylist(), flags, strict=True)
    return _table(BITS, _column([(c, kind, b, np.packbits(f).tobytes()) for c, b, f in where if f.any()], 4))


def _bits_of(table, kind: int) -> dict[int, bytes]:
    rows = zip(*(table.column(c).to_pylist() for c in ("kind", "bucket", "bits")), strict=True)
    return {b: x for k, b, x in rows if k == kind}


def _extend(window: int, bits: int, wide: int):
    def run(texts, answers):
        import numpy as np

        out = []
        if texts.num_rows and answers.num_rows:
            chunk, number = Chunk(texts, window), texts.column("chunk")[0].as_py()
            h1, h2, _, text = chunk.candidates(bits, _bits_of(answers, 0))
            first = _runs_first(h1, h2)
            h1, h2, text = h1[first], h2[first], text[first]
            buckets, cuts = _cuts(h1, wide)
            for b, x, y in zip(buckets, cuts[:-1], cuts[1:], strict=True):
                docs, local = np.unique(text[x:y], return_inverse=True)
                out.append((int(b), number, h1[x:y].astype("<u8").tobytes(), h2[x:y].astype("<u8").tobytes(),
                            local.astype("<u4").tobytes(), chunk.known[docs].tobytes(), chunk.row[docs].tobytes()))
        return _table(SECOND, _column(out, 7))

    return run


def _judge(table):
    """Which entries of a bucket hold a window that an earlier document of another chunk has too."""
    import numpy as np

    read = lambda c, kind: [np.frombuffer(x, kind) for x in table.column(c).to_pylist()]
    one, two, doc, ids, rows = read("h1", "<u8"), read("h2", "<u8"), read("doc", "<u4"), read("ids", "<i8"), read("rows", "<i8")
    h1, h2 = np.concatenate(one), np.concatenate(two)
    known = np.concatenate([i[d] for i, d in zip(ids, doc, strict=True)])
    row = np.concatenate([r[d] for r, d in zip(rows, doc, strict=True)])
    order = np.lexsort((row, known, h2, h1))
    later = np.ones(len(h1), dtype=bool)
    later[order[_runs_first(h1[order], h2[order])]] = False
    return _answers(table, 1, np.split(later, np.cumsum([len(x) for x in one])[:-1]))


OUT = "doc_id bigint, n_words bigint, n_removed bigint, text string"


def _cut(window: int, bits: int, wide: int):
    def run(texts, answers):
        from itertools import compress

        import numpy as np

        if not texts.num_rows:
            return _table(OUT, [[], [], [], []])
        chunk = Chunk(texts, window)
        covered = np.zeros(len(chunk.words.hashes) + 1, dtype=np.int64)
        if answers.num_rows:
            h1, h2, at, _ = chunk.candidates(bits, _bits_of(answers, 0))
            first = _runs_first(h1, h2)
            gone = np.repeat(_spread(h1[first], wide, _bits_of(answers, 1)), np.diff(np.concatenate([first, [len(h1)]])))
            later = np.ones(len(h1), dtype=bool)
            later[first] = False
            starts = at[gone | later]
            np.add.at(covered, starts, 1)
            np.add.at(covered, starts + window, -1)
        keep = np.cumsum(covered)[:-1] == 0
        cuts, out = chunk.words.first, []
        for i, text in enumerate(chunk.texts):
            words, mine = text.encode().split(), keep[cuts[i]:cuts[i + 1]]
            left = words if mine.all() else list(compress(words, mine.tolist()))
            out.append((chunk.ids[i], len(words), len(words) - len(left), b" ".join(left).decode()))
        return _table(OUT, _column(out, 4))

    return run


def dedup_passages(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, text (words left, joined by one space): one row per input row.

    A word goes if a window of ``window`` words covering it has the same words as a window
    that starts earlier: in a smaller doc_id, or before it in the same document.  Windows
    are judged on the input.

    NULL and empty texts have no words.  NULL is the smallest doc_id.  Rows sharing a doc_id
    follow each other by a hash of their text; of rows repeated as a whole one keeps its
    passages.  An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs[text_col], F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    chunks = pieces(size, CHUNK_BYTES, partitions(spark))
    bits = max(1, (pieces(size, BUCKET_WORDS * WORD_BYTES, 2 * partitions(spark)) - 1).bit_length())
    wide = max(1, bits - 2)
    base = docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))
    base = base.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "row"), F.lit(chunks)))
    base = base.repartition(partitions(spark), "chunk")
    by_chunk = lambda df: df.groupBy("chunk")
    hits = by_chunk(base).applyInArrow(_index(window, bits), FIRST).groupBy("bucket").applyInArrow(_probe, BITS)
    hits = hits.repartition(partitions(spark), "chunk")
    near = by_chunk(base).cogroup(by_chunk(hits)).applyInArrow(_extend(window, bits, wide), SECOND)
    later = near.groupBy("bucket").applyInArrow(_judge, BITS).repartition(partitions(spark), "chunk")
    return by_chunk(base).cogroup(by_chunk(hits.unionByName(later))).applyInArrow(_cut(window, bits, wide), OUT)
