"""Threshold-scaled sketches, and each document with the one after it, against plain versions."""

import functools
import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import queries, sketch
from graphloom.llm.sketch import containment, following, likeness, merged, shingle_hashes, sketched, sketches_of

LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, size=5):
    w = [x.decode() for x in (text or "").translate(LOWER).encode().split()]
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


@functools.cache
def hash_of(shingle):
    return int(shingle_hashes(pa.array([" ".join(shingle)]))[0][0])


def plain_sketch(text, scale=8):
    """From the hashes that the operator gives each shingle when it stands alone."""
    all_ = set(map(hash_of, shingles(text)))
    return sorted(h for h in all_ if h < 2**64 // scale) or sorted(all_)[:1]


def random_text(rng, n):
    return " ".join(rng.choice("the Of and Ünder river stone a b c d e f g h".split(), n))


def odd_texts():
    rng = np.random.default_rng(12)
    return [None, "", " \n\t", "one", "One", "a b c d", "a b c d e", "é\x0bü"] + [random_text(rng, n) for n in (6, 30, 90, 400, 6000)]


@pytest.mark.parametrize("scale", [1, 8, 500])
def test_sketches_like_a_plain_version(scale):
    texts = odd_texts()
    got = [[h % 2**64 for h in x] for x in sketches_of(pa.array(texts), scale=scale).to_pylist()]
    assert got == [plain_sketch(t, scale) for t in texts]
    assert got[3] == got[4] and got[:3] == [[], [], []]


def test_hashes_tell_shingles_apart():
    rng = np.random.default_rng(1)
    texts = [random_text(rng, 3000) for _ in range(20)]
    hashes, _ = shingle_hashes(pa.array(texts))
    assert len(set(hashes.tolist())) == len(set().union(*map(shingles, texts)))


def test_estimates_are_near_the_truth(spark):
    rng = np.random.default_rng(2)
    word = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 10**6, n))
    short, long, other = word(4000), word(30_000), word(4000)
    rows = spark.createDataFrame([(short, long + " " + short), (short, other), (short, short), ("", ""), ("", "x y"), ("a b", "a b")], "a string, b string")
    out = sketched(rows.withColumn("n", F.monotonically_increasing_id()).withColumn("sa", F.lit("clash")), {"a": "sa", "b": "sb"})
    got = out.orderBy("n").select(likeness(F.col("sa"), F.col("sb")), containment(F.col("sa"), F.col("sb"))).collect()
    assert abs(got[0][0] - 4 / 34) < 0.02 and got[0][1] > 0.98
    assert [tuple(r) for r in got[1:]] == [(0.0, 0.0), (1.0, 1.0), (1.0, 1.0), (0.0, 1.0), (1.0, 1.0)]


def test_sketches_merge(spark):
    texts = [t for t in odd_texts() if shingles(t)]
    for scale in (8, 10**6):
        rows = sketched(spark.createDataFrame([(i % 3, t) for i, t in enumerate(texts)] + [(None, "q r s")], "k int, text string"), {"text": "sketch"}, scale=scale)
        got = {}
        for r in merged(rows, "k", scale=scale).collect():
            got.setdefault(r.k, set()).add(r.hash % 2**64)
        for k in range(3):
            all_ = set().union(*(plain_sketch(t, 1) for t in texts[k::3]))
            assert got[k] == ({h for h in all_ if h < 2**64 // scale} or {min(all_)})
        assert len(got[None]) == 1


def brute_following(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    return [(d, t or "", order[(i + 1) % len(order)][1] or "") for i, (d, t) in enumerate(order)]


def test_following(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), f"text {i}" * (i % 5)) for i in rng.permutation(400)] + [(None, "first"), (1000, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"part": F.lit("clash"), "guest": F.lit(1), "tie": F.lit(2)})
    assert sorted(map(str, following(frame).collect())) == sorted(map(str, (spark.createDataFrame(brute_following(rows), "doc_id bigint, text string, next_text string").collect())))
    names = spark.createDataFrame([(f"k{i}", str(i)) for i in range(50)], "doc_id string, text string")
    order = [k[1:] for k in sorted(f"k{i}" for i in range(50))]
    assert {(r.text, r.next_text) for r in following(names).collect()} == set(zip(order, order[1:] + order[:1], strict=True))


def test_following_of_repeated_rows_and_few(spark):
    same = spark.createDataFrame([(1, "x")] * 30 + [(1, "y")] * 2 + [(None, "z")] * 3, "doc_id bigint, text string")
    got = [tuple(r) for r in following(same).collect()]
    assert len(got) == 35 and sum(t != n for _, t, n in got) == 3  # three kinds of rows in a ring
    assert [tuple(r) for r in following(same.where("text = 'z'").limit(1)).collect()] == [(None, "z", "z")]
    assert following(same.limit(0)).count() == 0


def test_query_like_a_plain_version(spark, tmp_path):
    docs = list(enumerate(odd_texts() * 4))
    spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    want = set()
    for d, t, following_ in brute_following(docs):
        cut = len(t) // 4
        edited = t[: len(t) - cut] + following_[:cut]
        a, b, c = (plain_sketch(x, sketch.SCALE) for x in (t, edited, following_))
        alike = lambda x, y: 1.0 if not x and not y else len(set(x) & set(y)) / len(set(x) | set(y))
        within = lambda x, y: 1.0 if not x else len(set(x) & set(y)) / len(x)
        hexed = lambda x: "".join(f"{h:016x}" for h in x)
        want.add((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(b), alike(a, b), alike(a, c), within(a, b), within(a, c)))
    assert {tuple(r) for r in queries.op12_fingerprints(spark, str(tmp_path)).collect()} == want
