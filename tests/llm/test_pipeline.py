"""The pipeline against a plain version over a small table."""

import base64
import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from graphloom.llm.simhash import fingerprint
from graphloom.scratch import exists, owned

WORDS = {"en": "the river ran past old houses where people sang songs of winter".split(), "de": "der fluss zog an alten häusern vorbei wo leute lieder vom winter sangen".split()}


def _text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang], n)) + "."


def _keys(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\f\r"))


def _plain(docs, items):
    """What the stages after language identification do, on lists."""
    held = {}
    for d, text in docs:
        for line in (text or "").split("\n"):
            if len(_keys(line)) >= 40:
                held.setdefault(_keys(line), set()).add(d)
    bad = {k: max(v) for k, v in held.items() if len(v) >= 5}
    out = []
    for d, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if bad.get(_keys(x), d) == d]
        if len(kept) == len(lines) or "\n".join(kept).strip(" \t\n\x0b\f\r"):
            out.append((d, "\n".join(kept)))
    fps = [fingerprint(t) for _, t in out]
    groups = list(range(len(out)))
    for i in range(len(out)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = groups[i], groups[j]
                groups = [min(a, b) if g in (a, b) else g for g in groups]
    out = [x for i, x in enumerate(out) if groups[i] == i]
    cut = lambda t: "".join(c if c.isalnum() or ord(c) > 127 else " " for c in _keys(t)).split()
    windows = {tuple(w[i : i + 10]) for w in map(cut, items) for i in range(max(1, len(w) - 9))}
    out = [(d, t) for d, t in out if not any(tuple(cut(t)[i : i + 10]) in windows for i in range(len(cut(t))))]
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return {(d, hashlib.sha256(np.array(enc.encode_ordinary(t), dtype="<u4").tobytes()).hexdigest()) for d, t in out}


def test_run_matches_a_plain_version(spark, tmp_path):
    rng = np.random.default_rng(5)
    shared = "This line stands in many of the documents of this corpus."
    item = _text(rng, "en", 25)
    docs = []
    for i in range(60):
        lang = ("en", "de")[i % 2]
        text = _text(rng, lang, 80)
        if i % 7 == 0:
            text += "\n  " + shared.upper()
        if i == 20:
            text = docs[4][1]
        if i == 21:
            text = docs[5][1] + "x"
        if i == 33:
            text += " " + item
        docs.append((i, text, lang, "s", len(text)))
    docs += [(100, None, "en", "s", None), (101, "123 456", "de", "s", 7), (102, shared, "en", None, 5), (103, shared + "\n\t \n", "en", "s", 5)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(docs, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    with owned() as tables:
        rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = [label for label, path in tables._paths if exists(spark, path)]
    assert left == ["stage-bpe"]
    tables.clear(spark)
    assert not [path for _, path in tables._paths if exists(spark, path)]
    with_letters = [(d, t) for d, t, *_ in docs if t and any(c.isalpha() for c in t)]
    assert {(r.doc_id, r.ids_sha256) for r in rows} == _plain(with_letters, [item])
    assert 33 not in {r.doc_id for r in rows} and 20 not in {r.doc_id for r in rows}


def test_stages_keep_the_columns_and_survive_odd_rows(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    odd = [(None, "words of a text " * 9, "en", "s", 1), (None, None, None, None, None), (3, "a" * 50_000, "en", "s", 2), (3, "a" * 50_000, "en", "s", 2), (4, "", "de", "s", 0)]
    spark.createDataFrame([(1, "one two")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == (2 if rows else 0)
