"""Plane files: exact round trips and CRCs over block borders."""

import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from graphloom.llm.token_store import crc32_joined, from_planes, read_tokens, to_planes, token_digests, write_tokens

JSON = P.path("byte_bpe_50k.json")


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [1, 7, 8, 1000])
def test_planes_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    planes = to_planes(ids, kind)
    assert len(planes) == (4 if kind == "byte" else 32)
    assert (from_planes(planes, n) == ids).all()


def test_joined_crcs():
    parts = [b"abc", b"", b"d" * 1000, b"xyz"]
    assert crc32_joined([zlib.crc32(p) for p in parts], list(map(len, parts))) == zlib.crc32(b"".join(parts))


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_documents_come_back_in_order(spark, tmp_path, kind):
    texts = [(5, "one two"), (2, None), (9, ""), (1, "word " * 300), (2, "again"), (7, "<|endoftext|> 日本"), (5, "one two")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    docs = docs.withColumn("ids", docs.text).withColumn("shard", docs.doc_id)
    write_tokens(docs, JSON, P.PATTERN, str(tmp_path / "t"), block=64, kind=kind)
    library = Tokenizer.from_file(JSON)
    want = [[*library.encode(t or "", add_special_tokens=False).ids, 0] for _, t in texts]
    rows = token_digests(spark, str(tmp_path / "t")).collect()
    crc = lambda ids: zlib.crc32(np.array(ids, dtype="<u4").tobytes())
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == sorted((d, len(w), crc(w)) for (d, _), w in zip(texts, want, strict=True))
    ordered = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted(d for d, _ in texts)
    assert [r.start for r in ordered] == [sum(r.n_tokens for r in ordered[:i]) for i in range(len(ordered))]
    back = {}
    for r in sorted(read_tokens(spark, str(tmp_path / "t")).collect(), key=lambda r: r.offset):
        back.setdefault((r.shard, r.seq, r.doc_id), []).extend(r.ids)
    assert sorted((d, ids) for (_, _, d), ids in back.items()) == sorted((d, w) for (d, _), w in zip(texts, want, strict=True))


def test_query_has_the_ids_of_the_library_by_default(spark, tmp_path):
    from graphloom.llm import queries

    texts = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|><|endoftext|>\n  y", "<|endoftext| >", "plain text", "é<|endoftext|>日本 ", None]
    docs = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    library = Tokenizer.from_file(JSON)
    want = [[*library.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    assert want[0] == [64, 220, 50256, 275, 0]
    rows = sorted(queries.op5_token_store(spark, str(tmp_path)).collect())
    crc = lambda ids: zlib.crc32(np.array(ids, dtype="<u4").tobytes())
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows] == [(i, sum(map(len, want[:i])), len(w), crc(w)) for i, w in enumerate(want)]


def test_special_strings_as_text_and_ids_of_any_type(spark, tmp_path):
    docs = spark.createDataFrame([("b", "x <|endoftext|>"), ("a", None)], "doc_id string, text string")
    write_tokens(docs, JSON, P.PATTERN, str(tmp_path / "t"), added=False)
    library = Tokenizer.from_file(JSON)
    library.encode_special_tokens = True
    want = [*library.encode("x <|endoftext|>", add_special_tokens=False).ids, 0]
    rows = token_digests(spark, str(tmp_path / "t")).orderBy("doc_id").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in rows] == [("a", 0, 1), ("b", 1, len(want))]
    assert {r.doc_id: r.ids for r in read_tokens(spark, str(tmp_path / "t")).collect()} == {"a": [0], "b": want}


def test_empty_and_null_ids(spark, tmp_path):
    docs = spark.createDataFrame([(None, "x"), (3, "y")], "doc_id bigint, text string")
    write_tokens(docs, JSON, P.PATTERN, str(tmp_path / "a"))
    rows = sorted(token_digests(spark, str(tmp_path / "a")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 3]
    write_tokens(docs.limit(0), JSON, P.PATTERN, str(tmp_path / "b"))
    assert token_digests(spark, str(tmp_path / "b")).count() == 0
    with pytest.raises(ValueError):
        write_tokens(docs, JSON, P.PATTERN, str(tmp_path / "c"), kind="nibble")
