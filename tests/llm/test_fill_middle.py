import random
import tempfile
from hashlib import sha256

import pytest

from meridia.llm import fill_middle as fm


def brute(doc_id, text, rate=90, spm=20):
    text = text or ""
    n = len(text)
    d = sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[i:i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("frame", [1 << 16, 7])
def test_against_brute_force(spark, monkeypatch, frame):
    rnd = random.Random(3)
    alphabet = ["a", "é", "<", "S", ">", "P", "M", "\U0001f600", "\n", "\x00", "中"]
    rows = [(i, "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 60)))) for i in range(150)]
    rows += [(200, None), (None, "no id"), (None, None), (201, ""), (202, "has <M> inside"), (203, "<" * 9), (204, "é" * 5), (7, rows[7][1]), (7, "other")]
    if frame > 7:
        rows.append((205, "long é \U0001f600 text " * 20000))
    monkeypatch.setattr(fm, "FRAME", frame)
    docs = spark.createDataFrame([(a, b, "x", 3) for a, b in rows], "doc_id long, text string, form string, n int").repartition(3)
    # frames of any size, in one process, so that the small frame size holds
    for doc_id, text in rows:
        f = fm.Frames()
        f.add_long(memoryview((text or "").encode()))
        _, n, form, p, m, want = brute(doc_id, text)
        out = fm.rewritten(f, form, None if p is None else (p, p + m))
        assert f.n == n and "".join(out.stream(0, out.n)) == want and "".join(fm.restored(out, form)) == (text or "")
    folder = tempfile.mkdtemp(prefix="spark-") + "/frames"
    fm.store(docs, folder)
    cut = fm.fill_middle(fm.load(spark, folder))
    key = lambda r: (r[0] is not None, r[0] or 0, r[-1])
    sha = lambda t: sha256((t or "").encode()).hexdigest()
    want = sorted((*brute(a, b)[:5], sha(b), sha(brute(a, b)[5])) for a, b in rows if a is not None)
    got = fm.digests(cut).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "restored_sha256", "output_sha256")
    got = [tuple(r) for r in got.collect()]
    assert sorted(r for r in got if r[0] is not None) == want
    assert sum(r[0] is None for r in got) == 2
    assert sorted((tuple(r) for r in fm.texts(cut, restore=True).select("doc_id", "text").collect()), key=key) == sorted(((a, b or "") for a, b in rows), key=key)
    assert {r.text for r in fm.texts(cut).collect()} == {brute(a, b)[5] for a, b in rows}
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_whole_frames_are_taken_over(monkeypatch):
    monkeypatch.setattr(fm, "FRAME", 10)
    f = fm.Frames()
    f.add_long(memoryview(b"0123456789" * 10))
    out = fm.rewritten(f, "psm", (25, 71))
    assert len(set(f.frames) & set(out.frames)) == 1 and sum(x == f.frames[0] for x in out.frames) == 8
    assert out.find("<S>", 0) == 28


def test_empty_table_and_marks(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    folder = tempfile.mkdtemp(prefix="spark-") + "/frames"
    fm.store(docs, folder)
    assert fm.digests(fm.fill_middle(fm.load(spark, folder))).count() == 0
    with pytest.raises(ValueError):
        fm.store(docs, folder + "2", marks=("<P>", "<S>", "P<"))
