"""Forms of text functions for ASCII find what the general ones find, and pairs need no shuffle."""

from pyspark.sql import functions as F

from graphloom.functions.text import SPACES, _unicode_key, is_ascii, normalize_key, slugify, strip
from graphloom.operators.heuristic import _ASCII_PATTERNS, PATTERNS, chunk_mentions, each_mention, pair_edges
from graphloom.operators.metadata import meta

_ODD = ["", " a_b--C\t d ", "\x1cX\x85", "(1.5 V)", "LPDDR5X, 12 nm\n\n\nprocess 6.4 Gb/s; CAS Latency 16 GB", "## 1.2 A//b_c -- d.", "3 µm ſilicon é", "#7", "a\x00b\x7f", "　Ä "]


def test_ascii_forms_equal_the_general_ones(spark):
    rows = spark.createDataFrame([(t,) for t in [*_ODD, *(f"{chr(c)}a{chr(c)}b{chr(c)}" for c in range(128))]], "t string")
    assert rows.where(strip("t") != F.regexp_replace("t", r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")).isEmpty()
    assert rows.where(normalize_key("t") != _unicode_key("t")).isEmpty()
    assert [r[0] for r in rows.limit(0).union(spark.createDataFrame([("## 1.2 A//b_c -- d.",), ("é ü",)], "t string")).select(slugify("t")).collect()] == ["1.2-A-b_c-d", "é-ü"]
    ascii_rows = rows.where(is_ascii(F.col("t")))
    for kind, pattern in PATTERNS.items():
        find = lambda p: F.regexp_extract_all("t", F.lit(p), F.lit(0))
        assert ascii_rows.where(find(pattern) != find(_ASCII_PATTERNS[kind])).isEmpty(), kind
    assert len(SPACES) == 29


def test_pairs_of_stored_mentions_are_those_of_rows_without_a_shuffle(spark):
    made = [("d", "s", i, 1, f"c{i}", "n", None, "text", "root/t", 1, text) for i, text in enumerate(_ODD * 2)]
    columns = "document_id string, source_path string, idx int, piece_idx int, chunk_id string, node_id string, parent_id string, node_type string, tree_path string, level int, content string"
    stored = chunk_mentions(spark.createDataFrame(made, columns).withColumn("metadata", meta()))
    found = pair_edges(stored)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    plain = pair_edges(each_mention(stored))
    assert sorted(found.collect(), key=str) == sorted(plain.collect(), key=str) != []
