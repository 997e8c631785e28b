"""Removal of lines that repeat across documents.

Normalised lines are exploded and hashed, distinct documents are counted for each
hash, and lines over the threshold go from every document but the one with the
largest id. Only hashes are shuffled to find the lines; each text is shuffled once,
to meet the positions that it loses, and its other lines are put together again by
position inside its row, in time that goes with their number.

Two 64-bit hashes with different seeds stand for a line's key, so that 10^12 lines
have no expected collision.

Lines that many documents share are never one task's: those that stand in over
1 / ``HOT_SHARE`` of all repeated places are ``HOT_SHARE`` at most and broadcast, all
others join by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import HOT_SHARE, SPACES, ascii_lower, join_counted, written

MIN_CHARS = 40
MIN_DOCS = 5


def line_key(line: Column) -> Column:
    """ASCII white space stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.trim(line, F.lit(SPACES)))


def _hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, uid, pos, line): hash and position of each line whose key has ``min_chars`` characters or more.

    ``uid`` tells rows with the same doc_id but different texts apart.
    """
    split = docs.select("doc_id", F.xxhash64("text").alias("uid"), _lines(F.col("text")).alias("lines"))
    lines = split.select("doc_id", "uid", F.posexplode_outer("lines").alias("pos", "line"))
    keys = lines.select("doc_id", "uid", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keys.select("doc_id", "uid", "pos", _hash(F.col("key")).alias("line"))


def repeated_lines(hashes: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(line, keep, n_docs): hash of each key that stands in ``min_docs`` documents or
    more, and the largest id of a document that has it.

    Rows with the same doc_id are one document; a null doc_id is an id too, below all
    others. The count goes through (hash, document) pairs first, so a line that a
    third of all documents share is spread over all tasks.
    """
    pairs = hashes.select("line", "doc_id").distinct()
    counted = pairs.groupBy("line").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keep"))
    return counted.where(F.col("n_docs") >= min_docs)


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, uid, drop): the positions that each document loses, if any."""
    hashes = written(line_hashes(docs, min_chars), "line-hashes")
    repeated = written(repeated_lines(hashes, min_docs), "repeated-lines")
    hits = join_counted(hashes, repeated.withColumnRenamed("n_docs", "n"), "line", HOT_SHARE)
    hits = hits.where(~F.col("doc_id").eqNullSafe(F.col("keep")))
    return hits.groupBy("doc_id", "uid").agg(F.collect_set("pos").alias("drop"))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Adds ``kept`` (the text without dropped lines), ``n_lines`` and ``n_dropped``.

    One row comes out for each row that goes in, with all its columns. A null or
    empty text is one empty line, which stays; so kept is never null. A document that
    loses all its lines gets an empty text. Rows with the same doc_id count as one
    document and lose the same lines; of equal lines inside the largest document all
    stay. Texts are read whole; one of any length is one row, its lines an array in
    there. An empty table gives an empty result. A clashing column named like an output
    is replaced.
    """
    gone = dropped_lines(docs.select("doc_id", "text"), min_chars, min_docs).select(F.col("doc_id").alias("_doc"), F.col("uid").alias("_uid"), "drop")
    whole = docs.drop("kept", "n_lines", "n_dropped", "_doc", "_uid", "drop", "_lines", "_kept")
    met = whole.join(gone, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_uid")), "left")
    met = met.withColumn("_lines", _lines(F.col("text")))
    # Sets of positions: array_except hashes them, so this is linear in the lines.
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("drop"))
    met = met.withColumn("_kept", F.when(F.col("drop").isNull(), F.col("_lines")).otherwise(F.transform(stay, lambda i: F.get("_lines", i))))
    return met.select(
        *whole.columns,
        F.array_join("_kept", "\n").alias("kept"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )
