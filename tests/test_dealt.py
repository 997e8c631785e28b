"""Graphs that are not stored: what they shuffle and leave behind."""

import os

import pytest
from pyspark.sql import functions as F

from graphloom.operators.heuristic import chunk_mentions, each_mention, mentions
from graphloom.operators.lookup import candidates as having
from graphloom.operators.lookup import index_names
from graphloom.plans.build import build, extracted
from graphloom.plans.store import nested, payloads
from graphloom.scratch import owned, shared_dir
from graphloom.sources.documents import from_table

_TEXT = "'# Part\n\nLPDDR5X has 16 GB of DRAM at 6400 MT/s; the die has a PHY.\n\n## Next\n\nDRAM, copper and ECC of part ' || id"


@pytest.fixture(scope="module")
def documents(spark):
    return from_table(spark.range(60), F.col("id"), F.expr(_TEXT), "notes")


def _rows(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_nodes_and_edges_that_are_not_kept_are_the_same(spark, documents):
    kept, made = build(documents), build(documents, keep=False)
    for table in ("nodes", "edges"):
        columns = [c for c in getattr(kept, table).columns if c != "metadata"]
        assert _rows(getattr(made, table), *columns) == _rows(getattr(kept, table), *columns)


def test_judged_rows_run_where_dealt_trees_and_mentions_are(spark, documents):
    graph = build(documents, keep=False)
    assert _shuffles(graph.nodes) == 0
    assert _shuffles(graph.edges) == 0


def test_only_dealt_trees_and_mentions_stay_in_the_folder(spark, documents):
    with owned() as tables:
        build(documents, keep=False)
    left = [path for _, path in tables._paths if os.path.exists(path)]
    assert {os.path.basename(p).rpartition("-")[0] for p in left} == {"by-document"}
    assert all(p.startswith(shared_dir(spark)) for p in left)


def test_mentions_of_chunks_are_those_of_rows(spark, documents):
    pieces = build(documents).chunks
    columns = ["document_id", "chunk_id", "pos", "entity_type", "name", "evidence", "text"]
    assert _rows(each_mention(chunk_mentions(pieces)), *columns) == _rows(mentions(pieces), *columns)


def test_trees_alone_are_those_of_payloads(spark, documents):
    paths = F.regexp_extract_all("tree", F.lit(r'"path":"([^"]*)"')).alias("paths")
    whole = payloads(build(documents)).select("document_id", F.get_json_object("payload", "$.tree").alias("tree"))
    assert _rows(nested(extracted(documents)[0]), "document_id", paths) == _rows(whole, "document_id", paths)


def test_nodes_that_stand_twice_are_found_once(spark, tmp_path):
    names = spark.createDataFrame([("d", "a", "DRAM"), ("d", "a", "DRAM"), ("d", "b", "DRA"), ("d", "c", "RAMs")], "document_id string, id string, name string")
    rest = {"entity_type": F.lit("t"), "tree_path": F.lit("p"), "seq": F.array(F.lit(1)), "review_reasons": F.array().cast("array<string>")}
    index_names(names.withColumns(rest), str(tmp_path))
    assert [r.id for r in having(spark, str(tmp_path), "dram").collect()] == ["a"]


def test_placed_rows_are_stored_by_document_and_not_dealt_again(spark):
    from graphloom.operators.blocks import components
    from graphloom.operators.tree import tree_nodes

    documents = spark.createDataFrame([(f"d{i}", f"d{i}", f"f/d{i}", "# A\n\ntext\n\n## B\n\nmore\n\n## B\n\nlast") for i in range(20)], "document_id string, document_name string, source_path string, content string")
    tree = tree_nodes(documents, components(documents))
    assert "Exchange" not in tree._jdf.queryExecution().executedPlan().toString()  # rows were shuffled once more for their keys
    assert sorted(r.path for r in tree.where("document_id = 'd3' AND node_type = 'section'").collect()) == ["root/A", "root/A/B", "root/A/B_1"]
