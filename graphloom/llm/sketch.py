"""Fingerprints of texts as threshold-scaled sketches of word shingles.

A sketch keeps every distinct shingle hash below a fixed fraction of all hashes, so it
grows with its text, and a short text can be held against a very long one: the share of
its hashes that the other has estimates how much of it the other contains. A text whose
hashes are all above the threshold keeps its smallest one, so that only texts without
words have an empty sketch. Both rules depend on the set of hashes alone, so sketches
merge: that of a union follows from those of its parts.

``following`` pairs each document with the next one in the order of ids. Ranges of ids
are cut once, by the keys alone; their first keys are broadcast, a document finds its range
by bisection, and the first one of each range is also sent to the range before it, so the texts are shuffled once
and no range needs to know another.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from graphloom.llm.common import batch_words, by_batches, written

SHINGLE = 5
#: One in so many hashes is kept.
SCALE = 8
#: Ranges of ids for each shuffle partition, so that tasks get even shares.
_RANGES = 8
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingle_hashes(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each shingle of some texts, A-Z lower-cased, and where each text's shingles end; fewer words make one."""
    flat, ends = batch_words(pc.ascii_lower(texts.cast(pa.large_string())))
    coded = flat.dictionary_encode()
    of_word = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
    words = of_word[coded.indices.to_numpy()]
    begins = np.concatenate(([0], ends[:-1]))
    sizes = ends - begins
    n = np.where(sizes > 0, np.maximum(sizes - shingle + 1, 1), 0)
    stops = np.cumsum(n)
    at = np.repeat(begins - stops + n, n) + np.arange(int(stops[-1]) if len(stops) else 0)
    last = np.repeat(ends, n)
    out = np.zeros(len(at), dtype=np.uint64)
    for i in range(shingle):
        there = at + i < last
        out = np.where(there, _mixed(out * _BASE + words[np.where(there, at + i, 0)] + np.uint64(1)) if len(words) else out, out)
    return out, stops


def sketches_of(texts: pa.Array, shingle: int = SHINGLE, scale: int = SCALE) -> pa.ListArray:
    """The sketch of each text: its kept hashes, ascending as unsigned numbers."""
    hashes, stops = shingle_hashes(texts, shingle)
    n = np.diff(stops, prepend=0)
    doc = np.repeat(np.arange(len(n)), n)
    keep = hashes <= np.uint64((1 << 64) // scale - 1)
    kept = np.bincount(doc[keep], minlength=len(n))
    bare = np.flatnonzero((n > 0) & (kept == 0))
    least = np.minimum.reduceat(hashes, (stops - n)[n > 0])[np.cumsum(n > 0)[bare] - 1] if len(bare) else np.empty(0, np.uint64)
    doc, hashes = np.concatenate((doc[keep], bare)), np.concatenate((hashes[keep], least))
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    cuts = np.searchsorted(doc[new], np.arange(len(n) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(hashes[new].view(np.int64)))


def sketched(rows: DataFrame, texts: dict[str, str], shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """The other columns with a sketch (array<bigint>) for each text column; ``texts`` maps them to the sketches' names.

    Words are parted by ASCII white space. A text of fewer words than a shingle is one
    shingle; a null text, or one without words, has an empty sketch. Texts are read whole,
    whatever their length; equal texts have equal sketches. Rows do not depend on each
    other, so repeated ones come out repeated. A column with a sketch's name is replaced.
    """
    if scale < 1 or shingle < 1:
        raise ValueError("scale and shingle must be positive")
    others = [f for f in rows.schema.fields if f.name not in texts and f.name not in texts.values()]
    slim = rows.select(*(f.name for f in others), *texts)
    schema = T.StructType([*others, *(T.StructField(name, T.ArrayType(T.LongType())) for name in texts.values())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sketches_of(b.column(len(others) + i), shingle, scale) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], *found], names=schema.names)

    return by_batches(slim, run, schema)


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of two texts' shingles that both have: of two without words 1, of one without 0."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first text's shingles that the second has; 1 without words."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def spelled(sketch: Column) -> Column:
    """A sketch as 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def merged(sketches: DataFrame, key: str, sketch: str = "sketch", scale: int = SCALE) -> DataFrame:
    """(key, hash): the sketch of each key's texts together, a row for each hash.

    A key may have any number of texts: hashes are told apart before they are shuffled, and
    no key is put together in one row. Keys without any hash have no row.
    """
    rows = sketches.select(key, F.explode(sketch).alias("hash")).distinct()
    low = F.col("hash").between(0, (1 << 64) // scale - 1) if scale > 1 else F.lit(True)
    unsigned = F.col("hash").bitwiseXOR(F.lit(-(1 << 63)))  # orders as the unsigned number does
    have = rows.groupBy(key).agg(F.bool_or(low).alias("some"), F.min_by("hash", unsigned).alias("least"))
    met = rows.withColumn("low", low).join(have.withColumnRenamed(key, "_of"), F.col(key).eqNullSafe(F.col("_of")))
    return met.where(F.when(F.col("some"), F.col("low")).otherwise(F.col("hash") == F.col("least"))).select(key, "hash")


def _ordered(key: Iterable) -> tuple:
    """A key that sorts as Spark sorts (doc_id, tie): nulls first."""
    doc_id, tie = key
    return doc_id is not None, doc_id, tie


def following(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): each document with the one after it in ascending order of ids, the last with the first.

    Rows that share an id stand by the hash of their text, then by the text; null ids come
    first. A null text is an empty one. A lone row follows itself, an empty table gives an
    empty one. Copies of a row (the same id and text) stay in one range.
    """
    spark = docs.sparkSession
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("tie"))
    key = F.struct("doc_id", "tie")
    n = _RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.select(key.alias("key")).repartitionByRange(n, "key")
    firsts = written(dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.min("key").alias("key")).select("key"), "ranges")
    bounds = sorted(map(_ordered, (r["key"] for r in firsts.collect())))  # one for each range
    if not bounds:
        return keyed.select("doc_id", "text", F.col("text").alias("next_text"))
    n = len(bounds)
    shared = spark.sparkContext.broadcast(bounds)

    @F.arrow_udf(T.IntegerType())
    def place(doc_id: pa.Array, tie: pa.Array) -> pa.Array:
        """Twice the range of a key, and one more for the first key of the range; keys alone go to Python."""
        keys = list(map(_ordered, zip(doc_id.to_pylist(), tie.to_pylist(), strict=True)))
        parts = [bisect.bisect_right(shared.value, k) - 1 for k in keys]
        return pa.array([2 * p + (shared.value[p] == k) for p, k in zip(parts, keys, strict=True)], pa.int32())

    placed = keyed.withColumn("place", place("doc_id", "tie")).withColumn("part", F.shiftright("place", 1))
    is_first = F.col("place") % 2 == 1
    before = F.when(F.col("part") == 0, n - 1).otherwise(F.col("part") - 1)
    places = F.array(F.struct(F.col("part"), F.lit(False).alias("guest")), F.when(is_first, F.struct(before.alias("part"), F.lit(True).alias("guest"))))
    rows = placed.select("doc_id", "tie", "text", F.explode(F.array_compact(places)).alias("to")).select("doc_id", "tie", "text", "to.*")
    in_order = Window.partitionBy("part").orderBy("guest", "doc_id", "tie", "text")
    return rows.withColumn("next_text", F.lead("text").over(in_order)).where("NOT guest").select("doc_id", "text", "next_text")
