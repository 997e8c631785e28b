"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training takes at most ``per_label`` rows of each language (the smallest by a hash of
their id) with their whole texts. Tasks count hashed 1- to 3-grams, Spark sums the
counts, and the log-probability matrix, one row for each bucket and one column for each
language, is broadcast in blocks of at most ``BLOCK`` languages: 64 MB each, whatever the
corpus and the number of languages. Scoring is numpy over batches of texts: all n-grams
of a batch are hashed at once, their matrix rows are gathered and summed for each text.
With more than one block the documents pass them one after another, each with the best
language so far and the sum of all likelihoods, and are written between the passes, so
that a task and the driver hold one block at a time.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import bounded_sample, by_batches, written

BUCKETS = 1 << 16
GRAMS = (1, 2, 3)
#: Rows of each language that are learned from, at most.
PER_LABEL = 1500
#: Languages whose matrix columns are broadcast together.
BLOCK = 128
UNKNOWN = "und"
_CELLS = 1 << 20  # of gathered matrix rows at a time
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


class Model(NamedTuple):
    """The matrix of some languages."""

    labels: list[str]
    log_prob: np.ndarray  # bucket x label
    prior: np.ndarray


class Counts:
    """Counts of all languages by bucket, as a stored table, and the matrix of each block of languages."""

    def __init__(self, table: DataFrame, labels: list[str], smoothing: float, block: int):
        self._table, self._smoothing = table, smoothing
        self._blocks = [labels[i : i + block] for i in range(0, len(labels), block)]

    def models(self) -> Iterator[Model]:
        """The blocks in order of their labels, each made when it is asked for."""
        for labels in self._blocks:
            rows = self._table.where(F.col("lang").between(labels[0], labels[-1])).toArrow()  # buckets x block rows at most
            counts = np.full((BUCKETS, len(labels)), self._smoothing)
            at = {x: i for i, x in enumerate(labels)}
            counts[rows["bucket"].to_numpy(), [at[x] for x in rows["lang"].to_pylist()]] += rows["n"].to_numpy()
            yield Model(labels, np.log(counts / counts.sum(axis=0)), np.zeros(len(labels)))


@functools.cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _points(text: str) -> np.ndarray:
    """Code points in lower case; everything but letters becomes a space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where(_letters()[points], points, 32)


def _buckets(points: np.ndarray) -> list[np.ndarray]:
    """For each n-gram length, the bucket of the n-gram at each place."""
    wide = points.astype(np.uint64)
    out = []
    for n in GRAMS:
        h = np.full(max(len(wide) - n + 1, 0), n, dtype=np.uint64)
        for k in range(n):
            h = (h ^ wide[k : k + len(h)]) * _FACTORS[k]
        out.append((h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32))
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and bool((_points(text) != 32).any())


def sample(docs: DataFrame, learn: Column, per_label: int = PER_LABEL) -> DataFrame:
    """(lang, text) of at most ``per_label`` rows for each label among those to learn from."""
    rows = docs.where(learn & F.col("lang").isNotNull()).select("doc_id", "lang")
    return bounded_sample(docs, rows, "lang", per_label)


def train(rows: DataFrame, smoothing: float = 0.5, block: int = BLOCK) -> Counts | None:
    """What (lang, text) rows tell of each language; None if there is no labelled text."""

    def table(counts: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, at in counts.items():
            used = np.flatnonzero(at)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(at[used])], names=["lang", "bucket", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if lang not in counts and len(counts) == BLOCK:
                    yield from table(counts)
                    counts.clear()
                at = counts.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                for grams in _buckets(_points(f" {text or ''} ")):
                    at += np.bincount(grams, minlength=BUCKETS)
        yield from table(counts)

    counted = written(by_batches(rows, count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "grams")
    labels = [r["lang"] for r in counted.select("lang").distinct().orderBy("lang").collect()]  # names alone
    return Counts(counted, labels, smoothing, block) if labels else None


def _step(model: Model) -> int:
    """n-grams scored at a time."""
    return max(1024, _CELLS // len(model.labels))


def _log_likelihood(model: Model, text: str) -> np.ndarray:
    total = np.zeros(len(model.labels))
    for grams in _buckets(_points(f" {text} ")):
        for at in range(0, len(grams), _step(model)):
            total += model.log_prob[grams[at : at + _step(model)]].sum(axis=0, dtype=np.float64)
    return total


def _scored(model: Model, texts: list[str]) -> np.ndarray:
    """Log-likelihoods of a batch: texts are joined by spaces and scored together."""
    points = [_points(f" {t} ") for t in texts]
    sizes = np.array([len(p) for p in points])
    starts = np.cumsum(sizes) - sizes
    out = np.zeros((len(texts), len(model.labels)))
    for n, grams in zip(GRAMS, _buckets(np.concatenate(points)), strict=True):
        if not len(grams):
            continue
        # n-grams over a border count for no text.
        over = np.maximum((starts + sizes)[:, None] - np.arange(1, n), starts[:, None]).ravel()
        found = model.log_prob[grams]
        found[over[over < len(grams)]] = 0
        out += np.add.reduceat(found, np.minimum(starts, len(grams) - 1), axis=0, dtype=np.float64)
    return out


def predict(docs: DataFrame, model: Counts | None) -> DataFrame:
    """All columns with ``lang_pred`` and ``score``.

    ``score`` is the posterior of the predicted label, from 0 to 1. A null text or one
    without a letter is ``und`` with score 0, as is everything if nothing was learned.
    Input columns of those names are replaced. Whole texts are scored, a very long one
    by parts of its n-grams; a score follows from its text alone, so repeated rows get
    the same. Of labels with equal posteriors the first in order is taken. An empty
    table gives an empty result.
    """
    whole = docs.drop("lang_pred", "score", "_best", "_all")
    passed = whole.withColumns({"lang_pred": F.lit(UNKNOWN), "_best": F.lit(None).cast("double"), "_all": F.lit(None).cast("double")})
    for i, block in enumerate(model.models() if model else ()):
        passed = _passed(written(passed, "passed") if i else passed, block)
    score = F.coalesce(F.exp(F.col("_best") - F.col("_all")), F.lit(0.0))
    return passed.select(*whole.columns, "lang_pred", score.alias("score"))


def _passed(rows: DataFrame, model: Model) -> DataFrame:
    """The rows with their best label so far, its log-likelihood, and the logarithm of the sum of all likelihoods."""
    place, n = rows.columns.index("text"), len(rows.columns) - 3
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            labels, best, all_ = (b.column(n + k).to_pylist() for k in range(3))
            for i, row in _likelihoods(model, b.column(place).to_pylist()):
                top = int(row.argmax())
                sum_ = float(row[top] + np.log(np.exp(row - row[top]).sum()))
                if best[i] is None or row[top] > best[i]:
                    labels[i], best[i] = model.labels[top], float(row[top])
                all_[i] = sum_ if all_[i] is None else float(np.logaddexp(all_[i], sum_))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(labels, pa.string()), pa.array(best, pa.float64()), pa.array(all_, pa.float64())], names=b.schema.names)

    return by_batches(rows, run, rows.schema)


def _likelihoods(model: Model, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(index, log-likelihoods) of the texts that have a letter."""
    held, size, step = [], 0, _step(model)

    def flush() -> Iterator[tuple[int, np.ndarray]]:
        yield from zip(held, _scored(model, [texts[i] for i in held]) + model.prior, strict=True)

    for i, t in enumerate(texts):
        if not has_letter(t):
            continue
        if len(t) >= step:
            yield i, _log_likelihood(model, t) + model.prior
            continue
        held.append(i)
        size += len(t)
        if size >= step:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def identify(docs: DataFrame, learn: Column, per_label: int = PER_LABEL) -> DataFrame:
    """Learns from the rows where ``learn`` holds and predicts all rows."""
    return predict(docs, train(sample(docs, learn, per_label)))
