"""Token-ID files: ids of all documents in doc_id order, in word-aligned 64-bit codes.

File format.  A folder of Parquet files written by Spark, one row per block, blocks
of whole documents of about ``BLOCK_IDS`` ids:

    part, block   place of the block: range partition, number inside it
    doc_ids       doc_id of each document of the block
    lengths       number of ids of each document
    words         little-endian 64-bit words: a selector in the upper 4 bits, ids below
    offsets       number of ids before every ``STRIDE``-th word, so stretches decode alone
    escapes       little-endian 64-bit values that no selector can hold

Selector s packs COUNTS[s] values of WIDTHS[s] bits.  Selector 0 is an escape: its 60
bits are the place of one value among the escapes.  Parquet's own commit makes a
retried task harmless; ids are packed and unpacked in numpy, a block at a time.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridia.llm.common import id_and_text, kept, map_slices, partitions, slices

# Fixed values of the code: values per word and bits of each, by selector.
COUNTS = (1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (60, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE, STRIDE, BLOCK_IDS = 0, 1024, 1 << 16

BLOCKS = "part int, block int, n_ids bigint, doc_ids array<bigint>, lengths array<int>, words binary, offsets binary, escapes binary"


def _classes(v):
    """For each value the smallest selector whose width holds it; selectors beyond the last hold none."""
    import numpy as np

    limits = np.array([1 << w for w in WIDTHS[1:]], dtype="<u8")
    small = np.searchsorted(limits, np.arange(1 << 16, dtype="<u8"), side="right").astype(np.uint8) + np.uint8(1)
    out = small[np.minimum(v, np.uint64((1 << 16) - 1)).astype(np.uint16)]
    wide = np.flatnonzero(v >> np.uint64(16))
    out[wide] = np.searchsorted(limits, v[wide], side="right") + 1
    return out


def pack(values) -> tuple[bytes, bytes, bytes]:
    """(words, offsets, escapes) of an array of unsigned integers."""
    import numpy as np

    v = np.asarray(values, dtype="<u8")
    n = len(v)
    big = v >= np.uint64(1 << 60)
    escapes = v[big]
    padded = np.zeros(n + max(COUNTS), dtype="<u8")
    padded[:n] = v
    need = _classes(padded)
    padded[:n][big] = np.arange(len(escapes), dtype="<u8")
    # the selector that packs the most values from each place on: the last one tried wins
    pick = np.full(n, len(COUNTS) - 1, dtype=np.uint8)
    most, span = need, 1  # the largest need among ``span`` values from each place on
    for s in range(len(COUNTS) - 2, 0, -1):
        while span < COUNTS[s]:
            more = min(span, COUNTS[s] - span)
            most = np.maximum(most[:-more], most[more:])
            span += more
        pick[most[:n] <= s] = s
    pick[big] = ESCAPE
    step = (np.arange(n) + np.asarray(COUNTS)[pick]).tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at = step[at]
    starts = np.asarray(starts, dtype=np.int64)
    chosen = pick[starts]
    words = chosen.astype("<u8") << np.uint64(60)
    for s in np.unique(chosen):
        rows = np.flatnonzero(chosen == s)
        if WIDTHS[s]:
            places = starts[rows]
            lanes = padded[places]
            for k in range(1, COUNTS[s]):
                lanes |= padded[places + k] << np.uint64(k * WIDTHS[s])
            words[rows] |= lanes
    return words.tobytes(), starts[::STRIDE].astype("<u4").tobytes(), escapes.tobytes()


def unpack(words: bytes, escapes: bytes, n: int):
    """The ``n`` values again, as unsigned 64-bit integers."""
    import numpy as np

    w, extra = np.frombuffer(words, "<u8"), np.frombuffer(escapes, "<u8")
    chosen = (w >> np.uint64(60)).astype(np.int64)
    counts = np.asarray(COUNTS)[chosen]
    starts = np.cumsum(counts) - counts
    out = np.zeros(n + max(COUNTS), dtype="<u8")
    for s in np.unique(chosen):
        rows = np.flatnonzero(chosen == s)
        if WIDTHS[s]:
            shifts = np.arange(COUNTS[s], dtype="<u8") * np.uint64(WIDTHS[s])
            lanes = (w[rows][:, None] >> shifts) & np.uint64((1 << WIDTHS[s]) - 1)
            out[starts[rows][:, None] + np.arange(COUNTS[s])] = extra[lanes.astype(np.int64)] if s == ESCAPE else lanes
    return out[:n]


#: Stretches one worker remembers, and the longest worth remembering.
REMEMBERED, LONGEST = 800_000, 64
#: New words encoded as one text: the library's cost per text is spread over them.
JOINED = 100
#: Texts per call of the library, whose results are large.
CALLED = 64
#: Rows and bytes of text looked up at a time.
ROWS, BYTES = 8192, 4 << 20
_SIMPLE = re.compile(r"[ \n][^\s\x00-\x20]+").fullmatch
#: White space beyond ASCII.
_WIDE = (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def cuts(data, begins):
    """Where texts fall into stretches that the usual byte-level pattern treats independently, as one flag a byte.

    ``data`` holds the UTF-8 bytes of texts side by side, ``begins`` where each begins.  A
    match holds white space only before what is visible, one space at most, and a letter and
    a comma are never in one match.  So a match begins, whatever is further left or right,
    at a space before something visible, at a single line feed between two visible signs,
    and at a comma or full stop behind a letter.
    """
    import numpy as np

    first = np.zeros(len(data) + 1, bool)
    first[begins] = first[-1] = True
    bytes_ = np.concatenate([data, np.zeros(2, np.uint8)])
    lead = np.flatnonzero(data == 0x20)
    after = bytes_[lead + 1]
    lead = lead[(after > 0x20) & ~first[lead + 1]]
    after = bytes_[lead + 1]
    doubt = np.flatnonzero((after == 0xC2) | (after >= 0xE1) & (after <= 0xE3))
    if len(doubt):
        one, two, three = (bytes_[lead[doubt] + k].astype(np.int64) for k in (1, 2, 3))
        point = np.where(one == 0xC2, two, (one & 15) << 12 | (two & 63) << 6 | three & 63)
        lead = np.delete(lead, doubt[np.isin(point, _WIDE)])
    feed = np.flatnonzero(data == 0x0A)
    feed = feed[~first[feed] & ~first[feed + 1]]
    before, after = bytes_[feed - 1], bytes_[feed + 1]
    feed = feed[(before > 0x20) & (before < 0x7F) & (after > 0x20) & (after < 0x7F)]
    mark = np.flatnonzero((data == 0x2C) | (data == 0x2E))
    mark = mark[~first[mark]]
    letter = (bytes_[mark - 1] | 0x20) - np.uint8(0x61)
    mark = mark[letter < 26]
    out = first[:-1]
    out[lead] = out[feed] = out[mark] = True
    return out


class Library:
    """Texts to ids (unsigned 32-bit) by the tokenizers library, which adds no tokens of its own.

    With ``added`` the contents of added tokens (``<|endoftext|>``) become their one id, as
    the library does by default; otherwise they are text like any other.  Texts are cut into
    stretches if the model has the usual byte-level pattern, and each distinct stretch is
    encoded once and remembered; when too many are, the less used half is forgotten.
    """

    def __init__(self, model: bytes, added: bool = True):
        import json
        import os

        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_str(model.decode())
        self.lib.encode_special_tokens = not added
        self.contents = [t.content for t in self.lib.get_added_tokens_decoder().values()] if added else []
        parts = json.loads(model)
        first = parts.get("pre_tokenizer") or {}
        usual = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space", True)
        self.cuttable = bool(usual and not parts.get("normalizer") and not parts.get("truncation") and not parts.get("padding"))
        # ids whose token begins with the byte of a space or line feed, as the vocabulary spells them
        self.begins = {}
        for lead, spelled in ((" ", "\u0120"), ("\n", "\u010a")):
            flags = np.zeros(max(self.lib.get_vocab().values()) + 1, bool)
            flags[[i for t, i in self.lib.get_vocab().items() if t.startswith(spelled)]] = True
            self.begins[lead] = flags
        self._store({}, np.zeros(0, "<u4"), np.zeros(0, np.int32), np.zeros(0, np.int32))

    def _store(self, known: dict[str, int], pool, lengths, used) -> None:
        """What is remembered: number of each stretch, ids of all side by side, and by number their length and uses."""
        self.known, self.pool, self.lengths, self.used = known, pool, lengths, used

    def _apart(self, texts: list[str]):
        """Ids of each text."""
        import numpy as np

        for at in range(0, len(texts), CALLED):
            for e in self.lib.encode_batch_fast(texts[at:at + CALLED], add_special_tokens=False):
                yield np.array(e.ids, "<u4")

    def _learn(self, texts: list[str]) -> None:
        """Encode new stretches and number them.

        Words that begin with a space or line feed and hold no other white space are encoded
        side by side: their joins are where the first token of a word begins with that character again.
        """
        import numpy as np

        lots: dict[str, list[str]] = {" ": [], "\n": []}
        rest, order, ids, lengths = [], [], [], []
        for t in texts:
            (lots[t[0]] if self.cuttable and _SIMPLE(t) and not any(c in t for c in self.contents) else rest).append(t)
        for lead, words in lots.items():
            groups = [words[at:at + JOINED] for at in range(0, len(words), JOINED)]
            for group, got in zip(groups, self._apart(["".join(g) for g in groups]), strict=True):
                starts = np.flatnonzero(self.begins[lead][got])
                if len(starts) != len(group) or starts[0]:
                    rest += group
                    continue
                order += group
                ids.append(got)
                lengths.append(np.diff(starts, append=len(got)).astype(np.int32))
        apart = list(self._apart(rest))
        order += rest
        ids += apart
        lengths.append(np.array([len(x) for x in apart], np.int32))
        self.known.update(zip(order, range(len(self.known), len(self.known) + len(order)), strict=True))
        self._store(
            self.known, np.concatenate([self.pool, *ids]), np.concatenate([self.lengths, *lengths]),
            np.concatenate([self.used, np.zeros(len(order), np.int32)]))

    def _gather(self, numbers):
        """(ids, lengths) of the remembered stretches with these numbers, one after the other."""
        import numpy as np

        lengths = self.lengths[numbers]
        ends = np.cumsum(lengths, dtype=np.int64)
        shift = (np.cumsum(self.lengths, dtype=np.int64) - self.lengths)[numbers] - (ends - lengths)
        places = np.repeat(shift, lengths)
        places += np.arange(len(places))
        return self.pool[places], lengths

    def _keep(self, numbers) -> None:
        """Forget all but these, given in ascending order."""
        words = list(self.known)
        self._store({words[i]: k for k, i in enumerate(numbers.tolist())}, *self._gather(numbers), self.used[numbers])

    def encode(self, texts):
        """(ids of all texts side by side, number of ids of each) of an Arrow array of strings; NULL has none."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        texts = pc.fill_null(texts, "")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw if raw is not None else b"", np.uint8)[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        if self.cuttable:
            flags = cuts(data, offsets[:-1])
            for content in self.contents:
                # white space before an added token ends a piece of text, so such a text cannot be cut at its spaces
                for k in np.flatnonzero(pc.match_substring(texts, content)).tolist():
                    flags[offsets[k] + 1:offsets[k + 1]] = False
        else:
            flags = np.zeros(len(data), bool)
            flags[offsets[:-1][np.diff(offsets) > 0]] = True
        at = np.flatnonzero(flags)
        edges = pa.py_buffer(np.append(at, len(data)).astype(np.int64))
        stretches = pa.LargeStringArray.from_buffers(len(at), edges, pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()

        words = stretches.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:
            self._keep(np.sort(np.argsort(-self.used, kind="stable")[:REMEMBERED // 2]))
        new = [w for w in words if w not in self.known]
        self._learn([w for w in new if len(w) <= LONGEST])
        lasting = len(self.known)
        self._learn([w for w in new if len(w) > LONGEST])
        numbers = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        self.used[numbers] += 1
        ids, lengths = self._gather(numbers[stretches.indices.to_numpy()])
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths, dtype=np.int64)])
        for _ in range(len(self.known) - lasting):
            self.known.popitem()
        self._store(self.known, self.pool[:self.lengths[:lasting].sum()], self.lengths[:lasting], self.used[:lasting])
        return ids, np.diff(ends[np.searchsorted(at, offsets)])

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian bytes."""
        ids, lengths = self.encode(texts)
        ends = lengths.cumsum()
        return [ids[a:b].tobytes() for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]


def library(model: bytes, added: bool = True) -> Library:
    """One per worker process and model."""
    return kept(("token_files", hash(model), added), lambda: Library(model, added))


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
              added: bool = True) -> None:
    """Write the ids of every document, ``end_id`` after each, to ``folder`` in ascending doc_id order.

    NULL and empty texts have only the end id.  NULL doc_ids come first; rows of one
    doc_id follow each other by text; repeated rows stay.  An empty table writes an
    empty folder; other columns are ignored.  ``added`` as in :class:`Library`.
    """
    import pyarrow as pa
    from pyspark import TaskContext
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark = docs.sparkSession
    with open(tokenizer, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())  # a vocabulary: some MB at most
    target = to_arrow_schema(StructType.fromDDL(BLOCKS))

    def run(batches):
        import numpy as np

        part, block = TaskContext.get().partitionId(), 0
        ids = library(model.value, added)
        held: list[tuple[int | None, int]] = []
        parts, size = [], 0

        def flush():
            values = np.concatenate(parts)
            words, offsets, escapes = pack(values)
            row = [part, block, len(values), [d for d, _ in held], [n for _, n in held], words, offsets, escapes]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, target, strict=True)], schema=target)

        for batch in batches:
            for some in slices(batch, ROWS, BYTES):
                got, lengths = ids.encode(some.column(1))
                got = np.insert(got, lengths.cumsum(), end_id)
                done = at = 0
                for doc, n in zip(some.column(0).to_pylist(), (lengths + 1).tolist(), strict=True):
                    held.append((doc, n))
                    size, at = size + n, at + n
                    if size >= BLOCK_IDS:
                        parts.append(got[done:at])
                        yield flush()
                        held, parts, size, block, done = [], [], 0, block + 1, at
                parts.append(got[done:])
        if held:
            yield flush()

    base = id_and_text(docs, id_col, text_col)
    ranged = base.repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first())
    ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(run, BLOCKS).write.parquet(folder)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, ids of every document of the files; ``start`` counts the ids of all documents before it.

    ``ids`` are little-endian unsigned 32-bit integers.  Starts come from sums per
    range partition and per block: one number each, no running sum over documents.
    """
    blocks = spark.read.schema(BLOCKS).parquet(folder)
    per_part = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    part_start = per_part.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    in_part = blocks.select("part", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("in_part"))
    starts = in_part.join(part_start, "part").select("part", "block", (F.col("in_part") + F.col("part_start")).alias("first"))
    placed = blocks.join(starts, ["part", "block"]).select("first", "n_ids", "doc_ids", "lengths", "words", "escapes")

    def step():
        import numpy as np

        def one(t):
            out = {"doc_id": [], "start": [], "ids": []}
            for r in t.to_pylist():
                ids = unpack(r["words"], r["escapes"], r["n_ids"]).astype("<u4")
                ends = np.cumsum(r["lengths"])
                begins = ends - r["lengths"]
                out["doc_id"] += r["doc_ids"]
                out["start"] += (begins + r["first"]).tolist()
                out["ids"] += [ids[a:b].tobytes() for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
            return out

        return one

    return map_slices(placed, step, "doc_id bigint, start bigint, ids binary", rows=4)
