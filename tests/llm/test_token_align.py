"""Alignment of two tokenizers against a plain version."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm.common import written
from graphloom.llm.token_align import align, summed
from graphloom.llm.token_store import token_bytes

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "a", "  two  spaces ", "tab\tand\n\nlines \n next", "▁ taken for a space", "naïve été ﬁ", "日本語のテキスト 漢字", "<s> </s> <0x41> <|endoftext|> <unk>",
    "\x00 control \x7f", "😀👩‍👩‍👧 emoji", "x" * 3000, "a b " * 2000, "trailing  ", "\n", "1234567890.5%", "don't they're",
]


def plain(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups text) of each text, by the libraries as they are."""
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    of = token_bytes(tokenizer)
    rows, counts = [], Counter()
    for text in texts:
        if not text:
            rows.append(None)
            continue
        a, b = tokenizer.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
        a_bytes = [of[i] for i in a]
        b_bytes = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        whole = (" " + text).encode()
        if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            rows.append(None)
            continue
        a_ends, b_ends = (np.cumsum(list(map(len, x))).tolist() for x in (a_bytes, b_bytes))
        groups, links, i, j, group = [], [], 0, 0, ([], [])
        while i < len(a):
            links.append((a[i], b[j]))
            end = min(a_ends[i], b_ends[j])
            step = a_ends[i] == end, b_ends[j] == end
            for side, ids, at in ((0, a, i), (1, b, j)):
                if step[side]:
                    group[side].append(ids[at])
            if all(step):
                groups.append(",".join(map(str, group[0])) + "|" + ",".join(map(str, group[1])))
                group = ([], [])
            i, j = i + step[0], j + step[1]
        counts.update(links)
        rows.append((len(a), len(b), groups, links))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    for r in rows:
        if r is None:
            yield (0, 0, 0, 0, 0, 0, "")
        else:
            n_a, n_b, groups, links = r
            yield n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), ";".join(groups)


def texts():
    rng = np.random.default_rng(11)
    vocab = "The river,  runs; unbelievable Straßenbahn façade x=1 naïve 中文 \n\t internationalization ...".split(" ")
    return ODD + [" ".join(rng.choice(vocab, n)) for n in (3, 40, 700, 700)] + ["a", "x" * 3000]


@pytest.mark.parametrize(("block", "hot"), [(16_384, 1_000_000), (7, 20)])
def test_align_like_a_plain_version(spark, block, hot):
    rows = texts()
    docs = [(i, t) for i, t in enumerate(rows)] + [(3, rows[3]), (None, "no id"), (None, "no id"), (None, "other")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"row": F.lit("clash"), "links": F.lit(1), "at": F.lit(2)})
    aligned = written(align(frame, A, P.PATTERN, B, block=block, texts=True), "aligned")
    want = list(plain([t for _, t in docs]))
    got = summed(aligned, hot).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest() if t else ""
    key = lambda r: (-1 if r[0] is None else r[0], *r[1:])
    assert sorted(map(key, (tuple(r) for r in got))) == sorted(key((d, *w[:6], sha(w[6]))) for (d, _), w in zip(docs, want, strict=True))
    spelled = aligned.groupBy("doc_id", "row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("groups_sha256").isNotNull().alias("last"), "groups"))), lambda r: r["groups"]), "").alias("groups"))
    if block > 10_000:
        assert sorted(r.groups for r in spelled.collect()) == sorted(w[6] for w in want)


def test_align_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id string, text string")
    assert summed(written(align(docs, A, P.PATTERN, B), "aligned")).count() == 0
    one = spark.createDataFrame([("x", None)], "doc_id string, text string")
    assert tuple(summed(written(align(one, A, P.PATTERN, B), "aligned")).first()) == ("x", 0, 0, 0, 0, 0, 0, "")
