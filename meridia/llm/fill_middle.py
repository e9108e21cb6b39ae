"""Fill-in-middle rewriting over seekable compressed texts.

A text is stored as independent zstandard frames of about ``FRAME`` bytes with the
running count of code points after each.  A range of code points is read by
decompressing the frames it touches.  The rewritten text is again such a list of
frames: frames that lie inside one part are taken over as they are, only the two
frames that hold the cuts are decompressed, cut and compressed again.  Digests stream
the frames in order, so a task holds one frame of a text, however long the text is.
Nothing is shuffled: a document is cut where it lies, by numbers drawn from its id.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.llm.common import id_and_text, map_slices

FRAME, LEVEL = 1 << 16, 3
#: The marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
STORED = "doc_id bigint, n bigint, marked boolean, ends array<bigint>, frames array<binary>"
CUT = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, ends array<bigint>, frames array<binary>"


class Frames:
    """Code points in independent frames; ``ends[i]`` counts those up to and with frame i."""

    def __init__(self, ends: list[int] | None = None, frames: list[bytes] | None = None):
        import zstandard

        self.ends, self.frames = ends or [], frames or []
        self._pack = zstandard.ZstdCompressor(level=LEVEL)
        self._unpack = zstandard.ZstdDecompressor()

    @property
    def n(self) -> int:
        return self.ends[-1] if self.ends else 0

    def append(self, units: int, frame: bytes) -> None:
        if units:
            self.ends.append(self.n + units)
            self.frames.append(frame)

    def add(self, text: str) -> None:
        """Append a text of at most about one frame."""
        if text:
            self.append(len(text), self._pack.compress(text.encode()))

    def add_long(self, data: memoryview) -> None:
        """Append UTF-8 of any length, cut into frames between code points."""
        at = 0
        while at < len(data):
            stop = min(at + FRAME, len(data))
            while stop < len(data) and data[stop] & 0xC0 == 0x80:
                stop += 1
            piece = bytes(data[at:stop])
            self.append(len(piece.decode()), self._pack.compress(piece))
            at = stop

    def text(self, i: int) -> str:
        return self._unpack.decompress(self.frames[i]).decode()

    def _touched(self, start: int, stop: int) -> Iterator[tuple[int, int, int]]:
        """(frame, first, last) of the frames that hold code points start to stop, counted inside the frame."""
        i = bisect_right(self.ends, start)
        while i < len(self.ends) and start < stop:
            before = self.ends[i - 1] if i else 0
            end = min(stop, self.ends[i])
            yield i, start - before, end - before
            start, i = end, i + 1

    def stream(self, start: int, stop: int) -> Iterator[str]:
        """Code points start to stop, a frame at a time."""
        for i, first, last in self._touched(start, stop):
            yield self.text(i)[first:last]

    def copy_to(self, other: Frames, start: int, stop: int) -> None:
        """Append a range to ``other``: whole frames as they are, cut ones compressed again."""
        for i, first, last in self._touched(start, stop):
            whole = first == 0 and last == self.ends[i] - (self.ends[i - 1] if i else 0)
            if whole:
                other.append(last, self.frames[i])
            else:
                other.add(self.text(i)[first:last])

    def find(self, mark: str, start: int) -> int:
        """Place of the first ``mark`` at or after ``start``."""
        held, at = "", start
        for piece in self.stream(start, self.n):
            held += piece
            found = held.find(mark)
            if found >= 0:
                return at + found
            keep = min(len(held), len(mark) - 1)
            at, held = at + len(held) - keep, held[len(held) - keep:]
        raise ValueError(f"no {mark} after {start}")


def _check(marks: tuple[str, str, str]) -> None:
    """Marks must not be able to arise where a mark and a text meet."""
    if len(set(marks)) < 3 or any(not m or any(m[0] in x[1:] for x in marks) for m in marks):
        raise ValueError("three different marks, whose first characters occur nowhere else in a mark")


def rewritten(text: Frames, form: str, cuts: tuple[int, int] | None, marks: tuple[str, str, str] = MARKS) -> Frames:
    """The frames of the output."""
    if form == "plain":
        return text
    a, b = cuts
    prefix, suffix, middle = ((marks[0], 0, a), (marks[1], b, text.n), (marks[2], a, b))
    out = Frames()
    for mark, start, stop in ((suffix, prefix, middle) if form == "spm" else (prefix, suffix, middle)):
        out.add(mark)
        text.copy_to(out, start, stop)
    return out


def restored(out: Frames, form: str, marks: tuple[str, str, str] = MARKS) -> Iterator[str]:
    """The text again, from the output and its form alone, a frame at a time."""
    if form == "plain":
        yield from out.stream(0, out.n)
        return
    first, second = (marks[1], marks[0]) if form == "spm" else (marks[0], marks[1])
    head = len(first)
    turn = out.find(second, head)
    last = out.find(marks[2], turn + len(second))
    front, back, middle = (head, turn), (turn + len(second), last), (last + len(marks[2]), out.n)
    prefix, suffix = (back, front) if form == "spm" else (front, back)
    for start, stop in (prefix, middle, suffix):
        yield from out.stream(start, stop)


def store(docs: DataFrame, folder: str, marks: tuple[str, str, str] = MARKS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write every text as frames to ``folder``: a row per row of ``docs``, other columns ignored.

    NULL is the empty text, which has no frame; a text of any length is cut into
    frames.  NULL ids and repeated rows stay; an empty table writes an empty folder.
    """
    _check(marks)

    def step():
        def one(t):
            out = {"doc_id": t.column("doc_id"), "n": [], "marked": t.column("marked"), "ends": [], "frames": []}
            for text in t.column("text"):
                f = Frames()
                f.add_long(memoryview(text.as_buffer()))
                out["n"].append(f.n)
                out["ends"].append(f.ends)
                out["frames"].append(f.frames)
            return out

        return one

    text = F.col("text")
    base = id_and_text(docs, id_col, text_col)
    held = F.contains(text, F.lit(marks[0])) | F.contains(text, F.lit(marks[1])) | F.contains(text, F.lit(marks[2]))
    map_slices(base.select("doc_id", "text", held.alias("marked")), step, STORED).write.parquet(folder)


def load(spark: SparkSession, folder: str) -> DataFrame:
    """The stored texts: doc_id, n code points, marked (holds a mark), ends, frames."""
    return spark.read.schema(STORED).parquet(folder)


def draws(seed: int, id_col: Column) -> list[Column]:
    """Four unsigned 32-bit numbers from the sha256 of ``seed:id``; a NULL id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def fill_middle(
    stored: DataFrame, seed: int = 1, rate: int = 90, spm: int = 20, marks: tuple[str, str, str] = MARKS
) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, ends, frames: the rewritten texts as frames.

    ``rate`` and ``spm`` are percentages: texts that are rewritten, and those of them
    whose suffix comes first.  Empty texts and texts that hold a mark stay plain, with
    NULL counts.  Cuts depend on the id only, so rows of one id with equal texts are cut
    alike and reruns agree; a NULL id has cuts like any other.
    """
    _check(marks)
    h = draws(seed, F.col("doc_id"))
    a, b = (h[i] % (F.col("n") + 1) for i in (0, 1))
    form = F.when((F.col("n") == 0) | F.col("marked") | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    planned = stored.select("doc_id", "n", form.alias("form"), F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), "ends", "frames")

    def step():
        def one(t):
            names = ("n", "form", "a", "b", "ends", "frames")
            out = {"doc_id": t.column("doc_id"), "n": t.column("n"), "form": t.column("form"),
                   "prefix_chars": [], "middle_chars": [], "ends": [], "frames": []}
            for _, form, a, b, ends, frames in zip(*(t.column(c).to_pylist() for c in names), strict=True):
                f = rewritten(Frames(ends, frames), form, (a, b), marks)
                out["prefix_chars"].append(None if form == "plain" else a)
                out["middle_chars"].append(None if form == "plain" else b - a)
                out["ends"].append(f.ends)
                out["frames"].append(f.frames)
            return out

        return one

    return map_slices(planned, step, CUT)


def digests(cut: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the sha256 of the output and of the text restored from it."""
    kept = ("doc_id", "n", "form", "prefix_chars", "middle_chars")

    def step():
        from hashlib import sha256

        def hexed(pieces) -> str:
            h = sha256()
            for piece in pieces:
                h.update(piece.encode())
            return h.hexdigest()

        def one(t):
            out = {c: t.column(c) for c in kept} | {"output_sha256": [], "restored_sha256": []}
            for form, ends, frames in zip(*(t.column(c).to_pylist() for c in ("form", "ends", "frames")), strict=True):
                f = Frames(ends, frames)
                out["output_sha256"].append(hexed(f.stream(0, f.n)))
                out["restored_sha256"].append(hexed(restored(f, form, marks)))
            return out

        return one

    return map_slices(cut, step, CUT.split(", ends")[0] + ", output_sha256 string, restored_sha256 string")


def texts(cut: DataFrame, marks: tuple[str, str, str] = MARKS, restore: bool = False) -> DataFrame:
    """doc_id, form, text: the rewritten texts, or with ``restore`` the original ones, for those who train on them."""

    def step():
        def one(t):
            found = []
            for form, ends, frames in zip(*(t.column(c).to_pylist() for c in ("form", "ends", "frames")), strict=True):
                f = Frames(ends, frames)
                found.append("".join(restored(f, form, marks) if restore else f.stream(0, f.n)))
            return {"doc_id": t.column("doc_id"), "form": t.column("form"), "text": found}

        return one

    return map_slices(cut, step, "doc_id bigint, form string, text string")
