import random
import tempfile
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from meridia.llm import token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 255), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=400))
def test_code_round_trip(values):
    words, _, escapes = token_files.pack(np.array(values, dtype="<u8"))
    assert token_files.unpack(words, escapes, len(values)).tolist() == values


def test_code_packs_runs_and_escapes():
    words, offsets, escapes = token_files.pack([0] * 120 + [1] * 60 + [2**63])
    assert len(words) == 24 and len(escapes) == 8 and len(offsets) == 4
    many = np.arange(40000) % 50257
    words, offsets, _ = token_files.pack(many)
    starts = np.frombuffer(offsets, "<u4")
    assert token_files.unpack(words[8 * token_files.STRIDE:], b"", len(many) - starts[1]).tolist() == many[starts[1]:].tolist()


LIBRARY = Tokenizer.from_file(PATH)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [2]


def test_stretches_and_joined_words_like_the_library():
    """Random texts of awkward pieces, with cold and warm caches, against the unmodified library."""
    rnd = random.Random(11)
    bits = ["word", "Wörter", "ÉTÉ", "x.", "end,", "'s", "12", "\n", "\n", " ", " ", " ", "\t", "\r", "\x0b", "\x01", "\x1c", "\u00a0", "\u3000", "$$$", "<|endoftext|>", "中文", "\U0001f600", "Ġ", "Ċ", "a" * 70]
    with open(PATH, "rb") as f:
        model = f.read()
    made = token_files.Library(model)
    plain, apart = token_files.Library(model, added=False), Tokenizer.from_file(PATH)
    apart.encode_special_tokens = True
    for _ in range(60):
        texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 30))) for _ in range(60)]
        assert [np.frombuffer(x, "<u4").tolist() for x in made(texts)] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(x, "<u4").tolist() for x in plain(texts)] == [apart.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("block", [1 << 16, 50])
def test_files_like_the_library(spark, monkeypatch, block):
    monkeypatch.setattr(token_files, "BLOCK_IDS", block)
    rows = [(5, "hello world  again"), (None, "no id"), (2, None), (2, ""), (9, "a\n b"), (7, "é " * 3000), (9, "<|endoftext|> x"), (7, "é " * 3000)]
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, start int")
    folder = tempfile.mkdtemp(prefix="spark-") + "/ids"
    token_files.write_ids(docs, folder, PATH, end_id=2)
    got = token_files.read_ids(spark, folder).orderBy("start").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for r, (doc, text) in zip(got, want, strict=True):
        one = ids(text)
        assert (r.doc_id, r.start) == (doc, at) and np.frombuffer(bytes(r.ids), "<u4").tolist() == one
        at += len(one)
    empty = tempfile.mkdtemp(prefix="spark-") + "/ids"
    token_files.write_ids(docs.limit(0), empty, PATH, end_id=2)
    assert token_files.read_ids(spark, empty).count() == 0


def test_whole_table(spark):
    from meridia.llm.queries import catalog

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    at = 0
    for r in catalog.queries["op5_token_files"](spark, sf).orderBy("doc_id").collect():
        one = ids(texts[r.doc_id])
        assert (r.start, r.n_tokens) == (at, len(one))
        assert r.ids_crc32 == zlib.crc32(np.array(one, "<u4").tobytes())
        at += len(one)


def test_added_tokens_like_the_unmodified_library(spark):
    """The query's files hold the one id of <|endoftext|> wherever the library finds it."""
    from meridia.llm.queries import catalog

    t = Tokenizer.from_file(PATH)
    e = "<|endoftext|>"
    texts = [f"a {e} b", f"a  {e}  b", f"x\n {e}", f"{e}{e} y {e}", f"a{e}b", f" {e} ", "<|endoftext|", "plain, words  here", f"x \t{e}", None, ""]
    sf = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{sf}/documents.parquet")
    at = 0
    for r in catalog.queries["op5_token_files"](spark, sf).orderBy("doc_id").collect():
        one = t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(one), zlib.crc32(np.array(one, "<u4").tobytes()))
        at += len(one)


class Counted:
    """The library, counting the characters it is given."""

    def __init__(self, lib):
        self.lib, self.chars = lib, 0

    def encode_batch_fast(self, texts, **options):
        self.chars += sum(map(len, texts))
        return self.lib.encode_batch_fast(texts, **options)


def plain(texts):
    return [np.array(LIBRARY.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_words_around_line_feeds_are_encoded_once():
    """Every end of a line meets every begin of the next: the library sees words, not their pairs."""
    with open(PATH, "rb") as f:
        made = token_files.Library(f.read())
    made.lib = Counted(made.lib)
    ends, begins = [f"end{chr(97 + i)}." for i in range(20)], [f"Begin{chr(97 + i)}" for i in range(20)]
    texts = [f"x {a}\n{b} y" for a in ends for b in begins]
    assert made(texts) == plain(texts)
    assert made.lib.chars < 1000


def test_used_words_outlive_the_others(monkeypatch):
    """When too many words are known, those that return are not encoded again."""
    monkeypatch.setattr(token_files, "REMEMBERED", 100)
    with open(PATH, "rb") as f:
        made = token_files.Library(f.read())
    made.lib = Counted(made.lib)
    often = "x " + " ".join(f"common{i}word" for i in range(30))
    for k in range(40):
        texts = [often, "x " + " ".join(f"rare{k}of{i}" for i in range(10))]
        assert made(texts) == plain(texts)
    once = len(often) + sum(len(f" rare{k}of{i}") for k in range(40) for i in range(10))
    assert made.lib.chars <= once + 100


def test_models_with_another_pattern_are_not_cut():
    import json

    with open(PATH, "rb") as f:
        model = json.load(f)
    texts = ["a word, and more.\nNext  line", "", "don't ,stop"]
    for pre in ({"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}):
        changed = json.dumps(model | {"pre_tokenizer": pre})
        want = Tokenizer.from_str(changed)
        got = token_files.Library(changed.encode())(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [want.encode(t, add_special_tokens=False).ids for t in texts]
