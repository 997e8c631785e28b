"""Runs: stretches of words that repeat with a period, by masking and Main-Lorentz.

A run of period q has at least ``max(least, times * q)`` words, so it overlaps itself,
shifted by q, in at least k words, the smallest such overlap over all q (16 for 24 words
and three times). Each of its words therefore lies in a k-gram that stands in the
document twice. All other words are masked out: they can't join a run, and cut the
document into segments, of which few survive in ordinary text.

A surviving segment is halved again and again. A run that crosses the middle matches
itself, shifted by its period, at the word before the middle or a period before that;
for all periods at once these places are tried by the hashes of half a k-gram next to
them, and where one agrees the match is extended both ways by binary search over prefix
hashes. What is found is held against the words themselves, so hashes decide nothing.

Texts stay in their tasks: nothing is shuffled, and memory goes with a batch of texts
and the longest of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from graphloom.llm.common import batch_words, by_batches

LEAST, TIMES = 24, 3
#: An odd number and what undoes multiplying by it, modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_UNDO = pow(_BASE, -1, 1 << 64)


def overlap(least: int = LEAST, times: int = TIMES) -> int:
    """The words that a run shares at least with itself, shifted by its period."""
    return min(max(least - q, (times - 1) * q) for q in range(1, least + 1))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads integers over 64 bits."""
    x = x.astype(np.uint64) + np.uint64(_BASE)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hashed:
    """Words as codes, with hashes of any stretch of them."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        n = len(codes) + 1
        self._sums = np.zeros(n, dtype=np.uint64)
        np.cumsum(_mixed(codes) * _powers(_BASE, n)[:-1], out=self._sums[1:])
        self._undo = _powers(_UNDO, n)

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self._sums[start + length] - self._sums[start]) * self._undo[start]

    def grams(self, k: int) -> np.ndarray:
        """The hash of the k words from each place on, where there are as many."""
        n = max(len(self.codes) - k + 1, 0)
        return (self._sums[k : k + n] - self._sums[:n]) * self._undo[:n]

    def ahead(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from ``a`` and from ``b`` on are the same, up to ``most``."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.of(a, mid) == self.of(b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def behind(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words up to ``a`` and up to ``b``, these not included, are the same."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.of(a - mid, mid) == self.of(b - mid, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def survivors(words: Hashed, ends: np.ndarray, k: int) -> Iterator[tuple[int, int]]:
    """Ranges of words that lie in k-grams which stand in their document twice; ``ends`` are the documents' ends."""
    grams = words.grams(k)
    doc = np.searchsorted(ends, np.arange(len(grams)), side="right")
    inside = np.arange(len(grams)) + k <= (ends[doc] if len(doc) else doc)
    place = np.flatnonzero(inside)
    keys = _mixed(grams[place] ^ _mixed(doc[place]))
    order = np.sort(keys)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return
    found = place[np.isin(keys, twice)]
    change = np.zeros(len(words.codes) + 1, dtype=np.int64)
    np.add.at(change, found, 1)
    np.add.at(change, found + k, -1)
    marked = np.cumsum(change)[:-1] > 0
    cut = np.zeros(len(marked), dtype=bool)  # a document begins
    cut[ends[:-1][ends[:-1] < len(marked)]] = True
    begins = np.flatnonzero(marked & (cut | ~np.concatenate(([False], marked[:-1]))))
    stops = np.flatnonzero(marked & (np.concatenate((cut[1:], [True])) | ~np.concatenate((marked[1:], [False])))) + 1
    yield from zip(begins.tolist(), stops.tolist(), strict=True)


def runs_in(words: Hashed, begin: int, end: int, least: int, times: int, k: int, grams: np.ndarray) -> dict[tuple[int, int], int]:
    """The runs of a segment: first word and end to smallest period. ``grams`` has the hashes of ``(k + 1) // 2`` words."""
    half = (k + 1) // 2
    found: dict[tuple[int, int], int] = {}
    todo = [(begin, end)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < least:
            continue
        mid = (lo + hi) // 2
        todo += [(lo, mid), (mid, hi)]
        periods = np.arange(1, (hi - lo) // times + 1)
        for at in (np.full(len(periods), mid - 1), mid - 1 - periods):  # a place that the run matches with the one a period on
            fits = (at >= begin) & (at + periods < end)
            p, i = periods[fits], at[fits]
            same = words.codes[i] == words.codes[i + p]
            p, i = p[same], i[same]
            if not len(p):
                continue
            near = np.zeros(len(p), dtype=bool)
            for a in (i - half + 1, i + 1):
                ok = (a >= begin) & (a + p + half <= end)
                near[ok] |= grams[a[ok]] == grams[(a + p)[ok]]
            p, i = p[near], i[near]
            if not len(p):
                continue
            first = i + 1 - words.behind(i + 1, i + 1 + p, i + 1 - begin)
            last = i + 1 + words.ahead(i + 1, i + 1 + p, end - (i + 1 + p)) + p
            long = last - first >= np.maximum(least, times * p)
            for s, e, q in zip(first[long].tolist(), last[long].tolist(), p[long].tolist(), strict=True):
                if found.get((s, e), q + 1) > q:
                    found[s, e] = q
    return {span: q for span, q in found.items() if _is_run(words.codes, *span, q, begin, end)}


def _is_run(codes: np.ndarray, s: int, e: int, q: int, begin: int, end: int) -> bool:
    """Whether the words repeat with the period, and no neighbour does; by the words themselves."""
    grows = (s > begin and codes[s - 1] == codes[s - 1 + q]) or (e < end and codes[e] == codes[e - q])
    return not grows and np.array_equal(codes[s : e - q], codes[s + q : e])


def _of_batch(doc_ids: pa.Array, texts: pa.Array, least: int, times: int, names: list[str]) -> pa.RecordBatch:
    flat, ends = batch_words(texts)
    words = Hashed(flat.dictionary_encode().indices.to_numpy().astype(np.int64))
    k = overlap(least, times)
    begins = np.concatenate(([0], ends[:-1]))
    runs: list[tuple[int, int, int, int]] = []
    grams = None
    for lo, hi in survivors(words, ends, k):
        if hi - lo >= least:
            grams = words.grams((k + 1) // 2) if grams is None else grams
            doc = int(np.searchsorted(ends, lo, side="right"))
            runs += [(doc, s - int(begins[doc]), e - s, q) for (s, e), q in runs_in(words, lo, hi, least, times, k, grams).items()]
    runs.sort(key=lambda r: (r[0], r[1], r[3]))
    doc, start, length, period = np.array(runs, dtype=np.int64).reshape(-1, 4).T
    change = np.zeros(len(flat) + 1, dtype=np.int64)
    np.add.at(change, begins[doc] + start + period, 1)
    np.add.at(change, begins[doc] + start + length, -1)
    keep = np.cumsum(change)[:-1] == 0
    kept = np.concatenate(([0], np.cumsum(keep)))[np.concatenate((begins[:1], ends))]
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), flat.filter(pa.array(keep))), pa.scalar(" ", flat.type)).cast(pa.string())
    spans = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], ["start", "length", "period"])
    of_doc = pa.array(np.searchsorted(doc, np.arange(len(ends) + 1)).astype(np.int32))
    return pa.RecordBatch.from_arrays([doc_ids, pa.array(ends - begins), pa.ListArray.from_arrays(of_doc, spans), collapsed], names=names)


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): the runs of each text, and the text without their repetitions.

    Words are parted by ASCII white space. A run has a smallest period q, at least
    ``max(least, times * q)`` words, and no neighbour that keeps the period; ``runs`` has
    (start, length, period) in words, by start, then period. ``collapsed`` has the words
    that no run holds behind its first q, joined by one space.

    A null or empty text has no words, no runs and an empty ``collapsed``. Texts are
    read whole, whatever their length. Rows do not depend on each other: repeated rows
    and ids come out repeated, an empty table gives an empty one. Other columns are not used.
    """
    if least < 2 or times < 2:
        raise ValueError("runs have two words and two periods at least")
    slim = docs.select("doc_id", "text")
    names = ["doc_id", "n_words", "runs", "collapsed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _of_batch(b.column(0), b.column(1), least, times, names)

    rest = T._parse_datatype_string("n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return by_batches(slim, run, T.StructType([slim.schema["doc_id"], *rest.fields]))
