"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.scratch import shared_dir, written

__all__ = ["SPACES", "TOKEN", "WORD", "ascii_lower", "ascii_words", "batch_words", "bounded_sample", "by_batches", "join_counted", "shared_dir", "words_of", "written"]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters, digits and everything beyond ASCII make words; for lower-cased text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: ASCII white space splits words; everything else belongs to one.
TOKEN = r"[^\x20\x09-\x0D]+"
#: Up to so many labels, what is known of each is broadcast; of more it meets the rows by a shuffle.
FEW_LABELS = 400
#: A key with more than one in so many rows is hot.
HOT_SHARE = 1000
#: Of texts that a Python worker gets at once.
BATCH_BYTES = 4 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"
SPACES = " \t\n\x0b\f\r"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone. Pure ASCII text takes the JVM's byte-wise ``lower``."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def ascii_words(text: Column) -> Column:
    """The words of a text (matches of ``WORD``) with A-Z lower-cased, in order; null gives an empty array.

    One pass maps capitals to small letters and all other ASCII to spaces, which is
    faster than a regex.
    """
    others = "".join(chr(i) for i in range(128) if not chr(i).isalnum())
    spaced = F.translate(F.coalesce(text, F.lit("")), _UPPER + others, _LOWER + " " * len(others))
    return F.array_remove(F.split(spaced, " ", -1), "")


def words_of(text: Column, pattern: str = WORD) -> Column:
    """All words of a text, in order; null gives an empty array."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({pattern})"), F.lit(1))


def batch_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Inside a task: all words (matches of ``TOKEN``) of some texts, and where each text's words end; null has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat, cuts = lists.flatten(), lists.offsets.to_numpy()
    is_word = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate(([0], np.cumsum(is_word)))
    return flat.filter(pa.array(is_word)), before[cuts[1:] - cuts[0]]


def by_batches(df: DataFrame, run: Callable, schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` over batches of a few megabytes.

    Spark's default of 10,000 rows is hundreds of megabytes of long texts, in the JVM and
    again in Python. Unless the session says otherwise, its batches get ``BATCH_BYTES``.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCHES, None) is None:
        conf.set(_BATCHES, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def join_counted(many: DataFrame, counted: DataFrame, key: str, share: int = HOT_SHARE) -> DataFrame:
    """Inner join with a written table that has one row for each key, whose ``n`` counts the rows it will meet.

    Hot keys, with over 1 / ``share`` of all rows, are ``share`` at most: they are broadcast,
    and their rows stay where they are. All other keys meet few rows each and join by a
    shuffle. The order of rows is not defined.
    """
    rows = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()["rows"]
    is_hot = F.col("n") > rows // share
    hot, cold = F.broadcast(counted.where(is_hot).drop("n")), counted.where(~is_hot).drop("n")
    rest = many.join(F.broadcast(hot.select(key)), key, "left_anti")
    return many.join(hot, key).unionByName(rest.join(cold, key))


def bounded_sample(docs: DataFrame, rows: DataFrame, label: str, most: int, few: int = FEW_LABELS) -> DataFrame:
    """(label, text) of at most ``most`` documents of each label among ``rows`` (doc_id, label), for fitting a model.

    The documents with the smallest hashes of their ids are taken; of rows that share an
    id, one text. Hashes are spread evenly, so all rows but about twice as many as needed
    are left out by their hash first, and what is gathered for a label is a bounded
    array of hashes. There may be any number of labels: up to ``few`` of them, counts and
    ids are broadcast, beyond that only those of labels with many rows are.
    """
    place = F.xxhash64("doc_id")
    sizes = written(rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).withColumn("size", F.col("n")), "sizes")
    spread = F.broadcast if sizes.count() <= few else lambda frame: frame
    share = (F.shiftrightunsigned(place, 1).cast("double")) / float(1 << 63)
    sized = join_counted(rows, sizes, label)
    near = sized.where(share * F.col("size") <= float(2 * most + 100)).select("doc_id", label, share.alias("place"))
    near = written(near.distinct(), "near")
    last = near.groupBy(label).agg(F.get(F.sort_array(F.collect_list("place")), most - 1).alias("last"))
    ids = near.join(spread(last), label).where(F.col("last").isNull() | (F.col("place") <= F.col("last"))).select("doc_id", label)
    found = docs.select("doc_id", "text").join(spread(ids), "doc_id")
    return found.groupBy("doc_id", label).agg(F.min_by("text", F.xxhash64("text")).alias("text")).select(label, "text")
