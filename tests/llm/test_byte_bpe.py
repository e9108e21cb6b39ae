import hashlib
import random

import public_tokenizers
import tiktoken

from meridia.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TRICKY = [
    "", " ", "  ", "\n", " \n \n b", "a\n b", "a  b   c", "x " * 5, "it's we'll I'M don't", "éèç 日本語 ไทย",
    "1234 56,789.00", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "\x1c a\x1d b", " a   b", "\U0001f600\U0001f601 ok", "<|endoftext|>",
    "tab\tand \tspace", "end ", "-- -- ---", "\x00\x01", "ab" * 4000,
]


def theirs():
    with open(PATH, "rb") as f:
        ranks = byte_bpe.read_ranks(f.read())
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_and_texts_like_the_library():
    ranks, enc = theirs()
    codec = byte_bpe.Codec(ranks, public_tokenizers.PATTERN)
    rnd = random.Random(5)
    letters = ["abcdefghijklmnopqrstuvwxyz", "ab", "thé inoesr", "01 \n\t", "абвг ж", "!?.,'s "]
    texts = TRICKY + ["".join(rnd.choice(rnd.choice(letters)) for _ in range(rnd.randrange(1, 400))) for _ in range(400)]
    for t in texts:
        want = enc.encode_ordinary(t)
        got = codec.encode(t)
        assert list(memoryview(got).cast("I")) == want, t[:50]
        assert codec.decode(got) == t.encode()


def test_query_form(spark):
    _, enc = theirs()
    rows = [(1, "a b c", "x"), (None, None, None), (3, "", "y"), (1, "a b c", "x"), (5, "word " * 30000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = byte_bpe.decode(byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN).collect()
    assert len(got) == 5
    texts = {(r[0], (r[1] or "").encode()) for r in rows}
    for r in got:
        assert (r.doc_id, bytes(r.decoded)) in texts
        assert list(memoryview(bytes(r.ids)).cast("I")) == enc.encode_ordinary(bytes(r.decoded).decode())
    assert byte_bpe.encode(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_whole_table(spark):
    from meridia.llm.queries import catalog

    _, enc = theirs()
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in catalog.queries["op1_byte_bpe"](spark, sf).collect():
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_a_worker_remembers_a_bounded_number_of_pieces():
    ranks = {bytes([b]): b for b in range(256)}
    codec = byte_bpe.Codec(ranks, r" ?\w+|\s+")
    words = [f"w{i}" for i in range(byte_bpe.STRETCHES + 1000)]
    for at in range(0, len(words), 50_000):
        got = codec.encode_all([" ".join(words[at:at + 50_000])])[0]
        assert codec.decode(got).decode() == " ".join(words[at:at + 50_000])
    assert len(codec.encode_all.known) <= byte_bpe.STRETCHES + 50_000
    assert len(codec.packed) <= byte_bpe.PIECES
