"""SimHash near-duplicates: bit-sliced comparison inside exact candidate buckets.

Each text gets a 64-bit fingerprint of its word shingles. Copies collapse to one
distinct fingerprint. Two fingerprints within ``radius`` bits agree in at least
``blocks - radius`` of ``blocks`` bit blocks, so all pairs that could link meet in a
bucket of such blocks; the number of blocks follows the number of fingerprints, which
keeps buckets small. A bucket over ``limit`` is split again by its free bits, which
stays exact for the same reason. Inside a bucket, targets stand as bit planes, 64 to
a machine word; distances of all queries to 64 targets at a time are updated with
carry-save counters, and a (query, word) cell is abandoned once all its distances
exceed the radius. A bucket emits a spanning forest of its links, never all pairs.
Components then spread over Spark by smallest labels with pointer jumping; nothing is
collected to the driver but counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import by_batches, join_counted, written
from graphloom.scratch import owned

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Fingerprints to a bucket, on average, from which more blocks are used.
CROWD = 256
#: Fingerprints from which a single bucket is split again.
LIMIT = 32_768
_CELLS = 50_000
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text, as an unsigned integer; 0 without words."""
    raw = text.encode() if isinstance(text, str) else text or b""
    words = raw.lower().split()  # of bytes: ASCII letters and white space alone
    if not words:
        return 0
    n, ones = max(1, len(words) - shingle + 1), np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65_536):
        part = [xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), SEED) for i in range(at, min(n, at + 65_536))]
        octets = np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) and the columns to keep: the fingerprint of each row's text, as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.large_binary() if pa.types.is_large_string(b.column(1).type) else pa.binary())
            fps = np.array([fingerprint(t.as_py(), shingle) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), *b.columns[2:]], names=["doc_id", "fp", *keep])

    slim = docs.select("doc_id", "text", *keep)
    kinds = {f.name: f for f in slim.schema.fields}
    return by_batches(slim, each, T.StructType([kinds["doc_id"], T.StructField("fp", T.LongType()), *(kinds[k] for k in keep)]))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _split(bits: list[int], n: int) -> list[list[int]]:
    return [list(map(int, x)) for x in np.array_split(bits, n) if len(x)]


def _masks(n: int, radius: int, crowd: int) -> list[int]:
    """Masks of fixed bits: any two fingerprints within the radius agree under one at least."""
    for blocks in range(radius + 1, 65):
        fixed = blocks - radius
        if n >> (64 * fixed // blocks) <= crowd or fixed > 4:
            break
    parts = [sum(1 << b for b in x) for x in _split(list(range(64)), blocks)]
    return [sum(x) for x in combinations(parts, fixed)]


def _refined(mask: int, radius: int) -> list[int]:
    """Masks that fix one more block of the free bits each."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << b for b in x) for x in _split(free, radius + 1)]


def _keys(fp: Column, masks: list[int]) -> Column:
    return F.explode(F.array(*(F.struct(F.lit(_signed(m)).alias("mask"), fp.bitwiseAND(F.lit(_signed(m))).alias("key")) for m in masks)))


def _buckets(fps: DataFrame, n: int, radius: int, crowd: int, limit: int) -> DataFrame:
    """(mask, key, fp): each fingerprint in each of its buckets, none of over ``limit``."""
    masks = _masks(n, radius, crowd)
    rows = fps.select("fp", _keys(F.col("fp"), masks).alias("k")).select("k.mask", "k.key", "fp")
    while any(64 - bin(m).count("1") > radius for m in masks):
        hot = rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
        hot = written(hot.select("mask", "key"), "crowded")
        masks = sorted(int(r["mask"]) & (1 << 64) - 1 for r in hot.select("mask").distinct().limit(len(masks)).collect())
        if not masks:
            break
        cold = rows.join(hot, ["mask", "key"], "left_anti")
        split = rows.join(hot, ["mask", "key"], "left_semi")
        nexts = F.coalesce(*(F.when(F.col("mask") == _signed(m), F.array(*(F.lit(_signed(x)) for x in _refined(m, radius)))) for m in masks))
        split = split.select(F.explode(nexts).alias("mask"), "fp").distinct()
        rows = written(cold.unionByName(split.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")), "buckets")
        masks = sorted({x for m in masks for x in _refined(m, radius)})
    return rows


def near_pairs(fps: np.ndarray, bucket: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius, of fingerprints that stand sorted by bucket.

    A cell is a query and a word of up to 64 targets of the same bucket. Counter bits
    ones, twos, fours and a saturated ``over`` hold 64 distances at a time.
    """
    n = len(fps)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    sizes = np.diff(np.r_[starts, n])
    words = -(-sizes // 64)
    first = np.r_[0, np.cumsum(words)]  # of each bucket's words
    slot = np.arange(n) - np.repeat(starts, sizes)
    word = np.repeat(first[:-1], sizes) + slot // 64
    lane = (slot % 64).astype(np.uint64)
    base = np.repeat(starts, words) + 64 * (np.arange(first[-1]) - np.repeat(first[:-1], words))
    valid = np.zeros(first[-1], dtype=np.uint64)
    np.bitwise_or.at(valid, word, np.uint64(1) << lane)
    planes = np.zeros((64, first[-1]), dtype=np.uint64)
    for b in range(64):
        np.bitwise_or.at(planes[b], word, (fps >> np.uint64(b) & np.uint64(1)) << lane)

    # A query meets its own word and those behind it, so that each pair meets once.
    ahead = np.repeat(first[1:], sizes) - word
    ahead[np.repeat(sizes, sizes) == 1] = 0
    ends = np.cumsum(ahead)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _CELLS, side="right")))
        query = np.repeat(np.arange(at, to), ahead[at:to])
        cell = np.repeat(word[at:to] - (np.cumsum(ahead[at:to]) - ahead[at:to]), ahead[at:to]) + np.arange(len(query))
        at = to
        ones, twos, fours, over = (np.zeros(len(query), dtype=np.uint64) for _ in range(4))
        over |= ~valid[cell]
        for b in range(64):
            d = planes[b][cell] ^ (np.uint64(0) - (fps[query] >> np.uint64(b) & np.uint64(1)))
            carry = ones & d
            ones ^= d
            d = twos & carry
            twos ^= carry
            over |= fours & d
            fours ^= d
            if b % 8 == 7:
                over |= _beyond(ones, twos, fours, radius)
                live = over != _FULL
                query, cell, ones, twos, fours, over = (x[live] for x in (query, cell, ones, twos, fours, over))
                if not len(query):
                    break
        if len(query):
            hits = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            c, k = np.nonzero(hits)
            q, t = query[c], base[cell[c]] + k
            yield q[q < t], t[q < t]


def _beyond(ones: np.ndarray, twos: np.ndarray, fours: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose three-bit count is over the radius (0 to 7)."""
    out = np.zeros_like(ones)
    for count in range(radius + 1, 8):
        out |= (fours if count & 4 else ~fours) & (twos if count & 2 else ~twos) & (ones if count & 1 else ~ones)
    return out


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index of each index's component, over pairs taken part by part."""
    root = np.arange(n)
    for a, b in pairs:
        while len(a):
            ra, rb = root[a], root[b]
            open_ = ra != rb
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            low = np.minimum(ra, rb)
            np.minimum.at(root, ra, low)
            np.minimum.at(root, rb, low)
            while not np.array_equal(up := root[root], root):
                root = up
    return root


def _compare(radius: int):
    """Task function: rows (mask, key, fp) sorted by bucket to links (a, b)."""

    def links(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        mask, key, fp = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(3))
        bucket = np.cumsum(np.r_[False, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
        fps = fp.view(np.uint64)
        root = forest(len(fps), near_pairs(fps, bucket, radius))
        linked = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[root[linked]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held, n = [*held, b], n + b.num_rows
            if n < 4 * LIMIT:
                continue
            # All but the last bucket, which may go on in the next batch.
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            mask, key = whole.column(0).to_numpy(), whole.column(1).to_numpy()
            others = np.flatnonzero((mask != mask[-1]) | (key != key[-1]))
            at = int(others[-1]) + 1 if len(others) else 0
            if at:
                yield links([whole.slice(0, at)])
            held, n = [whole.slice(at)], whole.num_rows - at
        if n:
            yield links(held)

    return run


def near_links(fps: DataFrame, n: int, radius: int = RADIUS, crowd: int = CROWD, limit: int = LIMIT) -> DataFrame:
    """(a, b): links between distinct fingerprints that keep every component whole."""
    rows = _buckets(fps, n, radius, crowd, limit)
    dealt = rows.repartition("mask", "key").sortWithinPartitions("mask", "key")
    return by_batches(dealt, _compare(radius), "a bigint, b bigint").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each linked node reaches.

    Each round takes the smallest label among a node's neighbours, then the label's
    own label. Rounds are written to the shared folder, the one before is removed (and
    nothing that others wrote), and they end when none changes. Nodes with many neighbours, and labels that many nodes
    have, are broadcast: they are a thousand at most.
    """
    spark, before = links.sparkSession, None
    both = links.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    both = written(both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "links")
    degrees = both.groupBy("src").agg(F.min("dst").alias("low"), F.count(F.lit(1)).alias("n"))
    labels = written(degrees.select(F.col("src").alias("node"), F.least("src", "low").alias("label"), "n"), "labels")
    while True:
        with owned() as tables:
            seen = join_counted(both, labels.withColumnRenamed("node", "dst"), "dst").groupBy("src").agg(F.min("label").alias("low"))
            lower = labels.join(seen, F.col("node") == F.col("src")).select("node", F.col("label").alias("was"), F.least("label", "low").alias("label"), "n")
            lower = written(lower, "lower")
            roots = lower.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
            roots = written(roots.join(lower.select(F.col("node").alias("label"), F.col("label").alias("up")), "label"), "roots")
            jumped = join_counted(lower.withColumnRenamed("n", "degree"), roots, "label").withColumnRenamed("degree", "n")
            nexts = written(jumped.select("node", "was", F.least("label", "up").alias("label"), "n"), "labels")
        labels = nexts.select("node", "label", "n")
        tables.clear(spark, but="labels")
        if before is not None:
            before.clear(spark)
        before = tables
        if nexts.where(F.col("was") != F.col("label")).isEmpty():
            return labels.drop("n")


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, crowd: int = CROWD, limit: int = LIMIT, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, component_id) for each row, with the columns to keep.

    A null or empty text has fingerprint 0 and is linked like any other. component_id
    is the smallest doc_id reachable, the row's own included; null only if all ids of
    the component are null. Texts are read whole, a very long one by 65,536 shingles at a
    time. Repeated rows come out repeated, an empty table gives an empty one. Other columns of docs are
    not used; kept ones must not be named fp or component_id. ``radius`` is at most 6, what three counter bits hold.
    """
    if not 0 <= radius <= 6:
        raise ValueError("radius must be from 0 to 6")
    each = written(fingerprints(docs, shingle, keep), "fingerprints")
    nodes = written(each.groupBy("fp").agg(F.min("doc_id").alias("smallest"), F.count(F.lit(1)).alias("n")), "nodes")
    links = written(near_links(nodes.select("fp"), nodes.count(), radius, crowd, limit), "found")
    labels = components(links)
    named = labels.join(nodes, F.col("node") == F.col("fp")).select("fp", "label", "smallest")
    least = written(named.groupBy("label").agg(F.min("smallest").alias("component_id"), F.count(F.lit(1)).alias("n")), "least")
    linked = join_counted(named, least, "label").select("fp", "component_id")
    of = nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "smallest").alias("component_id"), "n")
    of = written(of, "components")
    # Copies never meet in one task.
    return join_counted(each, of, "fp").select("doc_id", "fp", "component_id", *keep)
