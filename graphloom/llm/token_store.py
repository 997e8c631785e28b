"""Token ids as files of shuffled planes, and back.

Documents are dealt by ranges of doc_id into shards and encoded in order. Each shard's
ids form blocks of a fixed size; a block is transposed into byte or bit planes, so that
like bits stand together, and each plane is compressed with zstandard. Blocks are rows
of a Parquet table whose other columns are the chunk index: which documents have ids
in the block, where each begins in the shard and how many ids stand here. A reader of
the index alone never touches the planes. Spark's writer commits each task's file, so
a lost executor leaves nothing half written.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from graphloom.llm.common import by_batches
from graphloom.llm.pieces import KEPT_BYTES, Ids, TextEncoder, runs

if TYPE_CHECKING:
    from tokenizers import Tokenizer

BLOCK = 65_536
END = 0
_LEVEL = 3



def _schema(doc_id: T.DataType) -> T.StructType:
    """Of the files; ``doc_id`` is the type of one id."""
    longs = T.ArrayType(T.LongType())
    kinds = {
        "shard": T.IntegerType(), "block": T.IntegerType(), "n_ids": T.IntegerType(), "planes": T.ArrayType(T.BinaryType()), "doc_id": T.ArrayType(doc_id),
        "seq": longs, "at": longs, "n_tokens": longs, "offset": longs, "length": longs,
    }
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The compressed planes of a block of uint32 ids, lowest byte or bit first."""
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    planes = np.ascontiguousarray(octets.T) if kind == "byte" else np.packbits(np.unpackbits(octets, axis=1, bitorder="little").T, axis=1, bitorder="little")
    press = zstandard.ZstdCompressor(level=_LEVEL)
    return [press.compress(p.tobytes()) for p in planes]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The ids of a block; four planes hold bytes, thirty-two hold bits."""
    raw = [np.frombuffer(zstandard.ZstdDecompressor().decompress(p), dtype=np.uint8) for p in planes]
    if len(raw) == 4:
        octets = np.stack(raw, axis=1)
    else:
        bits = np.unpackbits(np.stack(raw), axis=1, bitorder="little")[:, :n]
        octets = np.packbits(bits.T, axis=1, bitorder="little")
    return np.ascontiguousarray(octets).view("<u4").reshape(-1)


#: Characters that byte-level tokenizers write for bytes: printable ones for themselves,
#: the others in order from U+0100; fixed values.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = [i for i in range(256) if i not in _SHOWN]
_AS_CHARACTERS = {i: chr(256 + _HIDDEN.index(i)) for i in _HIDDEN}


def token_bytes(tokenizer: Tokenizer) -> dict[int, bytes]:
    """The bytes that each token of a byte-level tokenizer stands for."""
    of = {chr(i): i for i in _SHOWN} | {c: i for i, c in _AS_CHARACTERS.items()}
    added = tokenizer.get_added_tokens_decoder()
    plain = {i: bytes(of[c] for c in token) for token, i in tokenizer.get_vocab().items() if i not in added}
    return plain | {i: t.content.encode() for i, t in added.items()}


class Encoder:
    """Ids of texts by a tokenizer file; with ``added`` its added tokens are cut out first, as the library does by default.

    With ``lead`` a text gets a space in front.
    """

    def __init__(self, path: str, pattern: str, added: bool, lead: bool = False, kept_bytes: int = KEPT_BYTES):
        import regex
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self._merge = tokenizer.model.tokenize
        self._texts = TextEncoder(regex.compile(pattern).findall, self._of_words, kept_bytes, lead)
        self._added = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items() if t.content} if added else {}
        for i, t in tokenizer.get_added_tokens_decoder().items() if added else ():
            if t.single_word or t.lstrip or t.rstrip or t.normalized and tokenizer.normalizer:
                raise ValueError(f"added token {i} takes more than its own text")
        self._cut = re.compile("|".join(map(re.escape, sorted(self._added, key=len, reverse=True))))

    def _of_words(self, words: pa.Array) -> Ids:
        # Of printable ASCII only the space has another character.
        shown = pc.replace_substring(words, " ", _AS_CHARACTERS[32]).to_pylist()
        others = pc.invert(pc.match_substring_regex(words, "^ ?[!-~]+$")).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(others).tolist():
            shown[i] = words[i].as_py().encode().decode("latin-1").translate(_AS_CHARACTERS)
        merge = self._merge
        found = [[t.id for t in merge(w)] for w in shown]
        sizes = np.array(list(map(len, found)), dtype=np.int64)
        return Ids(np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum())), sizes)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        plain: list[str] = []
        cut: list[list[int]] = []  # for each text the added ids between its plain parts
        for text in texts:
            held = [c for c in self._added if c in text]
            cut.append([self._added[x] for x in self._cut.findall(text)] if held else [])
            plain += self._cut.split(text) if held else [text]
        ids = self._texts.encode(plain)
        parts = np.split(ids.flat, np.cumsum(ids.sizes)[:-1]) if plain else []
        out, at = [], 0
        for between in cut:
            pieces = [parts[at]]
            for i, token in enumerate(between):
                pieces += [np.array([token], np.uint32), parts[at + i + 1]]
            out.append(np.concatenate(pieces) if between else pieces[0])
            at += len(between) + 1
        return out


@functools.lru_cache(maxsize=1)
def _encoder(path: str, pattern: str, added: bool) -> Encoder:
    """A worker keeps the encoder of the last tokenizer, with a bounded store of words, from task to task."""
    return Encoder(path, pattern, added)


def _encode_shard(path: str, pattern: str, end: int, block: int, kind: str, added: bool, names: list[str]):
    closing = np.array([end], dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, encoder = TaskContext.get().partitionId(), None
        held, index, n_held, number, seq, at = [], [], 0, 0, 0, 0

        def flush(ids: np.ndarray, of: pa.DataType) -> pa.RecordBatch:
            columns = [list(c) for c in zip(*index, strict=True)]
            row = [[shard], [number], [len(ids)], [to_planes(ids, kind)], *([c] for c in columns)]
            index.clear()
            types = [pa.int32()] * 3 + [pa.list_(pa.binary()), pa.list_(of)] + [pa.list_(pa.int64())] * 5
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=names)

        for b in batches:
            encoder = encoder or _encoder(path, pattern, added)
            of, doc_ids, texts = b.column(0).type, b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in runs(texts):
                for doc_id, found in zip(doc_ids[lo:hi], encoder.encode(texts[lo:hi]), strict=True):
                    ids = np.concatenate([found, closing])
                    offset = 0
                    while offset < len(ids):
                        part = ids[offset : offset + block - n_held]
                        index.append((doc_id, seq, at, len(ids), offset, len(part)))
                        held.append(part)
                        n_held, offset = n_held + len(part), offset + len(part)
                        if n_held == block:
                            yield flush(np.concatenate(held), of)
                            held, n_held, number = [], 0, number + 1
                    seq, at = seq + 1, at + len(ids)
        if n_held:
            yield flush(np.concatenate(held), of)

    return run


def write_tokens(docs: DataFrame, tokenizer: str, pattern: str, path: str, end: int = END, block: int = BLOCK, kind: str = "byte", added: bool = True) -> None:
    """Encodes each document's text and writes the ids, ``end`` after each, to ``path``.

    ``tokenizer`` is a byte-level BPE file of the tokenizers library, without added
    spaces, whose words match ``pattern``. The strings of its added tokens become their
    ids, as the library does by default; without ``added`` they are ordinary text, as with
    its ``encode_special_tokens``.
    Documents stand in ascending doc_id order over all shards, null ids first; rows that
    share an id stand by the hash of their text. A null text is an empty one; ids keep
    their type. Texts are encoded whole: a block ends where it is full, inside a document
    too, so a very long text takes many blocks. An empty table gives files without rows.
    Other columns are not used.
    """
    if kind not in ("byte", "bit"):
        raise ValueError(f"kind must be byte or bit, not {kind}")
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", text.alias("text"), F.xxhash64("text").alias("tie"))
    dealt = slim.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    schema = _schema(docs.schema["doc_id"].dataType)
    by_batches(dealt, _encode_shard(tokenizer, pattern, end, block, kind, added, schema.names), schema).write.parquet(path)


def _kind(table: DataFrame) -> str:
    """The type of a document's id."""
    return table.schema["doc_id"].dataType.elementType.simpleString()


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(shard, doc_id, seq, at, n_tokens, offset, ids): the ids of each document, block by block."""
    table = spark.read.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                r = b.slice(row, 1).to_pylist()[0]
                ids = from_planes(r["planes"], r["n_ids"]).astype(np.int32)
                cuts = np.r_[0, np.cumsum(r["length"])].astype(np.int32)
                n = len(r["doc_id"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["shard"]] * n, pa.int32()), b.column("doc_id")[row].values, *(pa.array(r[k], pa.int64()) for k in ("seq", "at", "n_tokens", "offset")), pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids))],
                    names=["shard", "doc_id", "seq", "at", "n_tokens", "offset", "ids"],
                )

    return by_batches(table, run, f"shard int, doc_id {_kind(table)}, seq bigint, at bigint, n_tokens bigint, offset bigint, ids array<int>")


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2) modulo the CRC-32 one, bits reflected."""
    out = 0
    while a:
        if a & 0x80000000:
            out ^= b
        a = a << 1 & 0xFFFFFFFF
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def crc32_joined(crcs: list[int], lengths: list[int]) -> int:
    """CRC-32 of a concatenation, from the parts' CRC-32 values and lengths in bytes."""
    total = 0
    for crc, n in zip(crcs, lengths, strict=True):
        shift, power = 0x80000000, 0x00800000  # x^0 and x^8
        while n:
            if n & 1:
                shift = _times(shift, power)
            power, n = _times(power, power), n >> 1
        total = _times(total, shift) ^ crc
    return total


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files.

    ``start`` counts the ids of all documents before. Parts of a document that lies over
    several blocks are checked apart, and only their CRCs meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "doc_id", "seq", "at", "n_tokens", "offset", "length", "crc"]
        for b in batches:
            for row in range(b.num_rows):
                r = b.slice(row, 1).to_pylist()[0]
                raw = memoryview(from_planes(r["planes"], r["n_ids"]).tobytes())
                cuts = 4 * np.r_[0, np.cumsum(r["length"])]
                crc = [zlib.crc32(raw[a:z]) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
                columns = [r[k] for k in ("seq", "at", "n_tokens", "offset", "length")]
                longs = [pa.array(c, pa.int64()) for c in (*columns, crc)]
                yield pa.RecordBatch.from_arrays([pa.array([r["shard"]] * len(crc), pa.int32()), b.column("doc_id")[row].values, *longs], names=names)

    @F.pandas_udf("long")
    def joined(parts: pd.Series) -> pd.Series:
        return parts.map(lambda p: p[0]["crc"] if len(p) == 1 else crc32_joined([x["crc"] for x in p], [4 * x["length"] for x in p]))

    table = spark.read.parquet(path)
    parts = by_batches(table, run, f"shard int, doc_id {_kind(table)}, seq bigint, at bigint, n_tokens bigint, offset bigint, length bigint, crc bigint")
    whole = parts.groupBy("shard", "seq", "doc_id", "at", "n_tokens").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "crc"))).alias("parts"))
    # One row for each shard: as many as tasks wrote.
    totals = table.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before"))
    return whole.join(starts, "shard").select(
        "doc_id", (F.col("before") + F.col("at")).cast("long").alias("start"), "n_tokens", joined("parts").alias("ids_crc32")
    )
