"""Benchmark decontamination by a prefix-filtered set join.

An item's windows (``window`` consecutive words; a shorter item is one window) are
sets of word shingles, ordered by how rare each is in the corpus. A document can hold
a whole window only if it holds the window's rarest shingle, so that shingle is the
necessary prefix at full containment, and the only token to join on. A candidate must
then pass the length bound (the document is as long as the window) and the positional
bound (the window, laid with its prefix shingle on the found place, ends inside the
document), and at last equal the document's words over the whole window.

The document side is never shuffled as words: exploded words meet the prefix tokens
in a hash join inside one stage. The benchmark is taken in blocks of at most
``block`` windows, each broadcast, so that what is broadcast has a fixed bound and a
benchmark of any size is matched whole. Which items a window stands in is kept apart,
and joined to what was found behind the verification.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import ascii_words, written

WINDOW = 10
SHINGLE = 3
#: Rows of windows, or of windows and items, that are broadcast at most.
BLOCK = 200_000
_SALTS = 16


def _shingle(words: str, at: Column, size: int) -> Column:
    """Hash of the shingle at a place; places past the end add nothing."""
    return F.xxhash64(F.lit(size), *(F.get(words, at + i) for i in range(size)))


def windows_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, words, wid): the windows of each item; ``wid`` has two hashes of the words.

    An item without words has none. Items with a null id have windows, which mark
    words as hit, but the id itself is not listed.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), ascii_words(F.col("text")).alias("words"))
    items = items.where(F.size("words") > 0)
    last = F.greatest(F.size("words") - window, F.lit(0))
    at = items.select("item_id", "words", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    cut = at.select("item_id", F.slice("words", F.col("at") + 1, F.lit(window)).alias("words"))
    return cut.withColumn("wid", F.struct(F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(1), "words").alias("h2")))


def _tokens(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """(doc_id, uid, words, pos, token): one row for each shingle of each document."""
    split = docs.select("doc_id", "uid", ascii_words(F.col("text")).alias("words"))
    placed = split.select("doc_id", "uid", "words", F.posexplode_outer("words").alias("pos", "_"))
    placed = placed.where(F.col("pos").isNotNull())
    tokens = [_shingle("words", F.col("pos"), s) for s in sizes]
    token = tokens[0] if len(tokens) == 1 else F.explode(F.array(*tokens))
    return placed.select("doc_id", "uid", "words", "pos", token.alias("token"))


def _found(docs: DataFrame, windows: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, uid, start, length, wid): where windows of one block occur."""
    sized = windows.withColumn("size", F.least(F.size("words"), F.lit(shingle)))
    sizes = sorted(r["size"] for r in sized.select("size").distinct().limit(shingle).collect())
    if not sizes:
        return None

    by_size = F.coalesce(*(F.when(F.col("size") == s, _shingle("words", F.col("offset"), s)) for s in sizes))
    shingles = sized.withColumn("offset", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("size"))))
    shingles = shingles.select("words", "wid", "offset", by_size.alias("token"))

    counts = _tokens(docs, sizes).join(F.broadcast(shingles.select("token").distinct()), "token", "left_semi")
    counts = counts.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarity = shingles.join(F.broadcast(counts), "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = Window.partitionBy("wid").orderBy("n", "offset")
    # A shingle that stands nowhere rules its window out.
    prefix = rarity.withColumn("rank", F.row_number().over(rarest)).where((F.col("rank") == 1) & (F.col("n") > 0))
    prefix = written(prefix.select("token", F.col("words").alias("window"), "wid", "offset"), "prefix")

    start = F.col("pos") - F.col("offset")
    length = F.size("window")
    fits = (start >= 0) & (start + length <= F.size("words"))
    same = F.slice("words", F.greatest(start, F.lit(0)) + 1, length) == F.col("window")
    hits = _tokens(docs, sizes).join(F.broadcast(prefix), "token").where(fits & same)
    return hits.select("doc_id", "uid", start.alias("start"), length.alias("length"), "wid")


def find_windows(docs: DataFrame, windows: DataFrame, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame | None:
    """Occurrences (doc_id, uid, start, length, wid) of distinct windows (words, wid); None if there are none."""
    blocks = math.ceil(windows.count() / block)
    found = []
    for k in range(blocks):
        part = windows.where(F.pmod(F.hash("wid"), F.lit(blocks)) == k) if blocks > 1 else windows
        found.append(_found(docs, part, shingle))
    found = [x for x in found if x is not None]
    return reduce(DataFrame.unionByName, found) if found else None


def _with_items(found: DataFrame, items: DataFrame, block: int) -> DataFrame:
    """(doc_id, uid, item_id): the items of the windows in each document.

    More rows of windows and items than ``block`` are dealt by window and a salt of the
    document, so that a window of many items and documents is spread too.
    """
    held = found.select("doc_id", "uid", "wid").distinct()
    if items.count() <= block:
        return held.join(F.broadcast(items), "wid").select("doc_id", "uid", "item_id")
    salted = items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    held = held.withColumn("salt", F.pmod(F.hash("doc_id", "uid"), F.lit(_SALTS)))
    return held.join(salted, ["wid", "salt"]).select("doc_id", "uid", "item_id")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """Adds ``n_words``, ``n_hit``, ``items`` (sorted array of ids) and ``contaminated``.

    One row comes out for each row that goes in, with all its columns (an input column
    named like an output is replaced). A null text has no words; an empty benchmark
    contaminates nothing. Rows that repeat a doc_id are judged each by its own text.
    Words are compared with A-Z lower-cased. Texts are searched whole: a document of any
    length is one row, whose words meet the prefixes one by one; rows with the same id and
    text are found once.
    """
    whole = docs.drop("n_words", "n_hit", "items", "contaminated", "_doc", "_uid")
    uid = F.xxhash64("text", "doc_id")
    slim = docs.select("doc_id", "text", uid.alias("uid"))
    judged = whole.withColumn("_uid", uid).withColumn("n_words", F.size(ascii_words(F.col("text"))).cast("long"))
    listed = written(windows_of(benchmark, window), "windows")
    found = find_windows(slim, written(listed.select("words", "wid").distinct(), "distinct-windows"), shingle, block)
    if found is None:
        hits = judged.withColumns({"n_hit": F.lit(0).cast("long"), "items": F.array().cast("array<string>")})
    else:
        found = written(found, "found")
        # Occurrences by start; each adds the words beyond what the ones before it cover.
        before = Window.partitionBy("doc_id", "uid").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
        end = F.col("start") + F.col("length")
        covered = F.coalesce(F.max(end).over(before), F.lit(0))
        fresh = F.greatest(end - F.greatest(F.col("start"), covered), F.lit(0))
        places = found.select("doc_id", "uid", "start", "length").distinct().withColumn("fresh", fresh)
        items = listed.where("item_id IS NOT NULL").select("wid", "item_id").distinct()
        both = places.select("doc_id", "uid", "fresh", F.lit(None).cast("string").alias("item_id"))
        both = both.unionByName(_with_items(found, written(items, "window-items"), block).withColumn("fresh", F.lit(0)))
        per_doc = (
            both.groupBy("doc_id", "uid")
            .agg(F.sum("fresh").alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("items"))
            .select(F.col("doc_id").alias("_doc"), F.col("uid").alias("_hit"), "n_hit", "items")
        )
        same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_uid") == F.col("_hit"))
        hits = judged.join(per_doc, same, "left")
    return hits.select(
        *whole.columns,
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
