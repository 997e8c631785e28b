"""Byte-level BPE against the tiktoken and tokenizers libraries."""

import base64
import functools

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphloom.llm.bpe import Bpe, bpe_round_trip
from graphloom.llm.pieces import Ids
from graphloom.llm.token_store import Encoder

RANKS = P.path("byte_bpe_50k.tiktoken")
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a \n b", "a  \n b", "\n\n", " \n", "a\n ", "don't we'll  'S", "  x", "x  y", "a\x1c b", "été  ÇA\t", "日本語 テキスト", "🙂 🙂🙂", "1234567 8", "=" * 700, "ab" * 400, "the" * 300 + " x", "A" * 300, "<|endoftext|> x", "é" * 200, "\x00 \x7f"]
TEXT = st.text(st.sampled_from("ab \n\t'stlé日🙂1=- \x1c"), max_size=40)


@functools.cache
def _tiktoken():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def _tokenizer():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@functools.cache
def bpe(path, pattern):
    return Bpe(path, pattern)


@functools.cache
def _encoder():
    return Encoder(P.path("byte_bpe_50k.json"), P.PATTERN, True)


@pytest.fixture
def tik():
    return _tiktoken()


def _ids(raw):
    return np.frombuffer(raw, dtype="<u4").tolist()


def _each(ids: Ids):
    return [x.tolist() for x in np.split(ids.flat, np.cumsum(ids.sizes)[:-1])] if len(ids.sizes) else []


def test_odd_texts_like_tiktoken(tik):
    coder = bpe(RANKS, P.PATTERN)
    got = coder.encode(ODD)
    assert _each(got) == [tik.encode_ordinary(t) for t in ODD]
    assert coder.decode(got) == [t.encode() for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_any_text_like_both_libraries(texts):
    assert _each(bpe(RANKS, P.PATTERN).encode(texts)) == [_tiktoken().encode_ordinary(t) for t in texts]
    lib = [x.ids for x in _tokenizer().encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in _encoder().encode(texts)] == lib


def test_long_words_take_the_same_merges(tik):
    rng = np.random.default_rng(3)
    coder = bpe(RANKS, P.PATTERN)
    words = ["".join(rng.choice(list(alphabet), n)) for alphabet in ("ab", "etaoinshr", "aA", "lL=") for n in (50, 90, 400, 1500)]
    assert _each(coder.encode(words)) == [tik.encode_ordinary(w) for w in words]


def test_words_of_a_megabyte(tik):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 1_000_000)), "a" * 1_000_000, "日本語の" * 80_000]
    for word in words:
        assert _each(bpe(RANKS, P.PATTERN).encode([word])) == [tik.encode_ordinary(word)]


def test_a_full_store_starts_anew(tik):
    coder = Bpe(RANKS, P.PATTERN)
    coder._texts._kept_bytes = 10
    for texts in (["one two", "two three"], ["three one", "four"], ["one"]):
        assert _each(coder.encode(texts)) == [tik.encode_ordinary(t) for t in texts]


def test_rows_of_a_table(spark, tik):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None), (None, "x"), (3, "")], "doc_id bigint, text string")
    docs = docs.withColumn("ids", docs.text).withColumn("decoded", docs.text)
    rows = sorted((r.doc_id if r.doc_id is not None else -1, _ids(bytes(r.ids)), bytes(r.decoded)) for r in bpe_round_trip(docs, RANKS, P.PATTERN).collect())
    ab, x = tik.encode_ordinary("a b"), tik.encode_ordinary("x")
    assert rows == [(-1, x, b"x"), (1, ab, b"a b"), (1, ab, b"a b"), (2, [], b""), (3, [], b"")]
    assert bpe_round_trip(docs.limit(0), RANKS, P.PATTERN).count() == 0
