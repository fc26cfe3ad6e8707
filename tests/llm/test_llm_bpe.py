import hashlib
import struct

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from agrolith.llm import bpe, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def coder():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return bpe.ChunkEncoder(f.read(), bits=3)  # a cut every eight bytes or so


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def check(coder, plain, text):
    ids, decoded = coder.encode(text)
    want = plain.encode(text, add_special_tokens=False).ids
    assert ids == struct.pack(f"<{len(want)}I", *want), text
    assert decoded == plain.decode(want, skip_special_tokens=False), text


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text("abcDEF 's\n\t12é́ \x1c\x85<|>endoftx", max_size=80)))
def test_equals_the_tokenizer(coder, plain, text):
    check(coder, plain, text)


def test_chosen_texts(coder, plain):
    for text in ("", " ", "a<|endoftext|>b <|startoftext|>", "x" * 20_000, "İSTANBUL ΣΑΣ ς", "é É\ńx", "中文 字 \U0001f600", "don't we'll IT'S",
                 "shared passage of words " * 2000):
        check(coder, plain, text)


def test_cuts_depend_on_content_only():
    a, b = b"some first bytes ", b"other beginnings, longer "
    tail = bytes(range(32, 127)) * 40
    ends = lambda head: {e - len(head) for e in bpe.cuts(head + tail, 5) if e - len(head) > 32}
    assert ends(a) == ends(b) and len(ends(a)) > 20
    block, bpe._BLOCK = bpe._BLOCK, 100
    try:
        assert ends(a) == ends(b)
        got = bpe.cuts(tail, 5)
    finally:
        bpe._BLOCK = block
    assert got == bpe.cuts(tail, 5)


def test_caches_stay_bounded(plain, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_WORDS", 50)
    monkeypatch.setattr(bpe, "MAX_CHUNKS", 5)
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        small = bpe.ChunkEncoder(f.read(), bits=4)
    for k in range(30):
        check(small, plain, " ".join(f"w{k}x{i}" for i in range(40)))
        assert len(small.words) <= 90 and len(small.chunks) <= 5 and len(small.older_chunks) <= 5


def test_chunks_are_reused_across_texts_and_batches(plain):
    """A passage's chunks are encoded with the first text that holds it, and taken from the cache in all later ones."""
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        vocabulary = f.read()
    passage = " ".join(f"word{i * i % 977} of passage" for i in range(2000))
    first = bpe.worker_encoder(vocabulary)
    first.encode("some beginning " + passage)
    encoded, reused = first.encoded.size, first.reused.size
    for k in range(5):  # as later batches and tasks of the same worker do
        coder = bpe.worker_encoder(vocabulary)
        assert coder is first
        check(coder, plain, f"other words, {k} " * (k + 1) + passage + " and an end")
    again = first.reused.size - reused
    assert again >= 5 * 0.9 * len(passage) and first.encoded.size - encoded <= 5 * 0.1 * len(passage)
    assert first.reused.chunks > 5 * 50


def test_chunks_in_use_outlive_a_full_cache(plain, monkeypatch):
    """A chunk used again moves to the new generation; one not used for two generations is encoded anew."""
    monkeypatch.setattr(bpe, "MAX_CHUNKS", 4)
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        small = bpe.ChunkEncoder(f.read())
    for k in range(40):
        small.chunk(b" used often")
        small.chunk(b" used once %d" % k)
    assert (small.encoded.chunks, small.reused.chunks) == (41, 39)
    for k in range(8):
        small.chunk(b" other %d" % k)
    small.chunk(b" used often")
    assert small.encoded.chunks == 50


def test_operator_and_query(spark, plain):
    rows = [(1, "Some text"), (1, "Some text"), (2, None), (3, ""), (None, "x y")]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id bigint, text string, n_tokens string")
    got = bpe.encode_decode(df, "doc_id", "text", keep_ids=True).collect()
    assert len(got) == 5
    none = hashlib.sha256(b"").hexdigest()
    for r in got:
        if r["doc_id"] in (2, 3):
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["ids"]) == (0, none, none, [])
    assert bpe.encode_decode(df.limit(0), "doc_id", "text").count() == 0
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op9_bpe(spark, SF).collect():
        want = plain.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(plain.decode(want, skip_special_tokens=False).encode()).hexdigest()
