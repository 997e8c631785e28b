"""Runs of words against a plain search over all periods."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import queries
from graphloom.llm.periodic_runs import Hashed, overlap, periodic_runs, runs_in, survivors


def plain_runs(w, least=24, times=3):
    """(start, length, period) of all runs: for each period the maximal stretches that match a period on, then the smallest period of each."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(least, times * q):
                found.setdefault((s, i + q), q)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def words(text):
    return [x.decode() for x in (text or "").encode().split()]


def made(rng, n, vocab, parts):
    """Words with planted repetitions of many periods and lengths, some inside others."""
    w = list(rng.integers(0, vocab, n))
    for _ in range(parts):
        q = int(rng.integers(1, max(2, n // 4)))
        at, length = int(rng.integers(0, n)), int(q * rng.uniform(2, 7) + rng.integers(0, 12))
        for i in range(at + q, min(at + length, n)):
            w[i] = w[i - q]
    return w


def test_overlap_is_the_smallest():
    assert overlap() == 16 and overlap(10, 2) == 5
    for least, times in ((24, 3), (10, 2), (7, 4)):
        assert overlap(least, times) == min(n - q for q in range(1, 60) for n in range(max(least, times * q), 300))


@pytest.mark.parametrize(("least", "times"), [(24, 3), (10, 2), (6, 3)])
def test_runs_like_a_plain_search(least, times):
    rng = np.random.default_rng(13)
    k = overlap(least, times)
    for case in range(250):
        w = made(rng, int(rng.integers(1, 160)), int(rng.choice([1, 2, 3, 10, 1000])), int(rng.integers(0, 4)))
        hashed, found = Hashed(np.array(w)), []
        for lo, hi in survivors(hashed, np.array([len(w)]), k):
            found += [(s, e - s, q) for (s, e), q in runs_in(hashed, lo, hi, least, times, k, hashed.grams((k + 1) // 2)).items()]
        assert sorted(found, key=lambda r: (r[0], r[2])) == plain_runs(w, least, times), case


def test_words_outside_repeated_grams_are_masked():
    w = list(range(100)) + list(range(30, 50)) + list(range(200, 300))
    assert list(survivors(Hashed(np.array(w)), np.array([len(w)]), 16)) == [(30, 50), (100, 120)]
    # The same words in two documents are not repeated in either.
    assert list(survivors(Hashed(np.array([*range(40), *range(40)])), np.array([40, 80]), 16)) == []
    # Documents side by side are two segments.
    assert list(survivors(Hashed(np.zeros(80, dtype=int)), np.array([40, 40, 80]), 16)) == [(0, 40), (40, 80)]


def test_long_texts_of_one_word_and_of_two():
    for w in (np.zeros(60_000, dtype=int), np.arange(60_000) % 2):
        hashed = Hashed(w)
        found = runs_in(hashed, 0, len(w), 24, 3, 16, hashed.grams(8))
        assert found == {(0, 60_000): 1 + int(w[1])}


def odd_texts():
    rng = np.random.default_rng(5)
    texts = [None, "", " \t\n", "a", "a " * 23, "a " * 24, "a\n" * 100, "x y " * 40, " lead x y z\x0bw\x0c", "é ü " * 30 + "end", "w " * 5000]
    return texts + [" ".join(map(str, made(rng, n, 50, 3))) for n in (60, 300, 300, 900)]


def test_operator_on_odd_rows(spark):
    docs = [(i, t) for i, t in enumerate(odd_texts())] + [(6, "a " * 30), (6, "a " * 30), (None, "b " * 30)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"runs": F.lit("clash"), "n_words": F.lit("c"), "start": F.lit(1)})
    got = sorted((r.doc_id or -1, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in periodic_runs(frame).collect())
    want = []
    for d, t in docs:
        runs = plain_runs(words(t))
        want.append((d or -1, len(words(t)), tuple(runs), plain_collapsed(words(t), runs)))
    assert got == sorted(want)
    assert periodic_runs(frame.limit(0)).count() == 0
    with pytest.raises(ValueError, match="two"):
        periodic_runs(frame, times=1)


def test_query_like_a_plain_version(spark, tmp_path):
    docs = [(i, t) for i, t in enumerate(odd_texts() * 12)] + [(3, None), (None, "c " * 50)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()}
    want = set()
    for d, t in docs:
        w = words(t)
        h = 1 if d is None else zlib.crc32(str(d).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs = plain_runs(w)
        best = max(runs, key=lambda r: (r[1] * 10**9 // r[2], -r[0], -r[2]), default=(None, None, None))
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.add((d, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(plain_collapsed(w, runs))))
    assert got == want
    assert sum(r[1] > 0 for r in want) > 20
