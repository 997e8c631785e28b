"""The toxicity model learns from all labelled rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

toxicity = pytest.importorskip("graphloom.llm.toxicity")


def _plain(rows):
    counts = {}
    for label, text in rows:
        words = set(toxicity._LETTERS.findall((text or "").lower()))
        add = lambda kind, piece: counts.__setitem__((kind, piece), counts.get((kind, piece), 0) + 1)
        add("rows", str(label))
        for p in {p for w in words for p in toxicity.pieces(w)}:
            add("toxic" if label else "clean", p)
        for m in (f"^^{w}$" for w in words):
            for i in range(len(m) - 2):
                add("trigram", m[i : i + 3])
    return counts


@pytest.mark.parametrize("known, waiting", [(1_000_000, 4_000_000), (5, 7)])
def test_counts_like_one_by_one(monkeypatch, known, waiting):
    monkeypatch.setattr(toxicity, "_KNOWN", known)
    monkeypatch.setattr(toxicity, "_WAITING", waiting)
    rows = [(0, "stone river stone"), (1, "moron stone"), (1, None), (0, ""), (0, "a moron, ab"), (1, "river")]
    got = {}
    for b in toxicity._counts(pa.RecordBatch.from_pydict({"toxic": [r[0]], "text": pa.array([r[1]], pa.string())}) for r in rows):
        for kind, piece, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            got[kind, piece] = got.get((kind, piece), 0) + n
    assert got == _plain(rows)


def test_every_labelled_row_counts(spark):
    docs = spark.range(4600).select(F.col("id").alias("doc_id"), F.concat(F.lit("river w"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("text"))
    marks = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    seen = {}
    for b in toxicity.labelled(docs, marks, F.lit(True)).toArrow().to_batches():
        for kind, piece, n in (r for out in toxicity._counts(iter([b])) for r in zip(*(c.to_pylist() for c in out.columns), strict=True)):
            seen[kind, piece] = seen.get((kind, piece), 0) + n
    assert seen["rows", "0"] == seen["rows", "1"] == 2300  # 2,000 of a class before


def test_the_curve_is_that_of_all_points(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 300)
    x = np.round(rng.normal(y * 2.0, 1.0), 2)
    slope, offset = toxicity.fitted(spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, x, strict=True)], "toxic int, raw double"))
    w = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()) * len(y)
    p = 1 / (1 + np.exp(-(slope * x + offset)))
    assert abs((w * (p - y) * x).sum() + slope) < 1e-5 and abs((w * (p - y)).sum()) < 1e-5


def test_texts_meet_labels_alike_at_any_size(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("river stone").alias("text"))
    rows = toxicity.labelled(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic")), F.lit(True))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan  # few labels were broadcast, many not
    assert rows.count() == 400 and rows.rdd.getNumPartitions() == 1  # four tasks told their pieces before


def test_doubled_words_are_decoded_only_where_a_piece_may_stand(monkeypatch):
    model = toxicity.Model({"moron": 3.0, "^bell": 2.0, "oon": 1.5}, {}, 1.0, 0.0)
    words = ["moorroon", "mmoron", "stoone", "belll", "beel", "toons", "spoon", "aab²b", "moo-ron", "m00rroon", "xxyyzz"]
    asked = []
    decode = toxicity.decode
    monkeypatch.setattr(toxicity, "decode", lambda token, trigrams: asked.append(token) or decode(token, trigrams))
    got = [toxicity.Scorer(model)._token(w) for w in words]
    assert "xxyyzz" not in asked  # was decoded before
    monkeypatch.setattr(toxicity.Scorer, "_tells", lambda self, word: True)
    assert got == [toxicity.Scorer(model)._token(w) for w in words]
