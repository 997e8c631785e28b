"""The structural graph of a document tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.text import stable_id
from graphloom.operators.metadata import meta
from graphloom.plans.schema import ASSETS

#: Columns of nodes and edges. ``seq`` orders the rows of a document: array<int>, compared place by place.
NODE_COLUMNS = [
    "document_id", "seq", "id", "name", "entity_type", "description", "kind", "evidence_span", "evidence_status", "ontology_status",
    "tree_path", "source_path", "source_trace_id", "modality", "metadata",
]
EDGE_COLUMNS = [
    "document_id", "seq", "id", "src", "tgt", "relation_type", "description", "edge_source", "evidence_span", "evidence_status",
    "ontology_status", "confidence", "tree_path", "source_path", "metadata",
]


def kg_id(node_id: str):
    return F.concat(F.lit("tree:"), F.col(node_id))


def structural_nodes(nodes: DataFrame) -> DataFrame:
    """One graph node for each tree node, grounded by caption, path, body, content or title."""
    kind, m = F.col("node_type"), F.col("metadata")
    captions = lambda name: F.array_join(F.filter(F.coalesce(m[name], F.array().cast("array<string>")), lambda c: c != ""), "\n")
    content = F.when(F.col("content") != "", F.substring("content", 1, 500)).otherwise(F.col("title"))
    table = F.when(captions("table_caption") != "", captions("table_caption")).otherwise(F.substring(F.coalesce(m["table_body"], F.lit("")), 1, 500))
    has_captions = F.size(F.coalesce(m["image_caption"], F.array().cast("array<string>"))) > 0
    has_path = F.coalesce(m["img_path"], F.lit("")) != ""
    evidence = F.when((kind == "image") & has_captions, F.array_join(m["image_caption"], "\n")).when((kind == "image") & has_path, m["img_path"]).when(kind == "table", table).otherwise(content)
    asset = ((kind == "image") & (has_captions | has_path)) | ((kind == "table") & (table != ""))
    status = F.when(asset, "asset_grounded").when(kind == "table", "missing").otherwise("grounded")
    rows = nodes.select(
        "document_id", F.array(F.lit(0), "idx", F.lit(0)).alias("seq"), kg_id("node_id").alias("id"),
        F.when(kind.isin("root", "section"), F.col("title")).otherwise(F.concat(kind, F.lit(":"), "path")).alias("name"),
        F.when(kind.isin(*ASSETS), F.upper(kind)).otherwise("component").alias("entity_type"),
        F.concat(kind, F.lit(" node at "), "path").alias("description"), F.lit("structural").alias("kind"), evidence.alias("evidence_span"),
        status.alias("evidence_status"), F.lit("valid").alias("ontology_status"), F.col("path").alias("tree_path"), "source_path",
        F.lit("").alias("source_trace_id"), F.when(kind.isin(*ASSETS), kind).otherwise("text").alias("modality"), "metadata",
    )
    return rows.select(*NODE_COLUMNS)


def structural_edges(nodes: DataFrame) -> DataFrame:
    """parent_of and contains from each parent to its children, next_sibling between neighbours."""
    siblings = Window.partitionBy("document_id", "parent_id").orderBy("idx")
    above = F.regexp_replace("path", r"/[^/]*\z", "")
    rows = nodes.where(F.col("parent_id").isNotNull()).select(
        "document_id", "source_path", "idx", "path", above.alias("above"), kg_id("parent_id").alias("parent"), kg_id("node_id").alias("child"),
        F.concat(F.lit("tree:"), F.lead("node_id").over(siblings)).alias("after"), F.lead("path").over(siblings).alias("after_path"),
    )
    edge = lambda n, relation, src, tgt, text: F.struct(F.lit(n).alias("n"), F.lit(relation).alias("relation"), src.alias("src"), tgt.alias("tgt"), text.alias("text"))
    three = F.array(
        edge(0, "parent_of", F.col("parent"), F.col("child"), F.concat("above", F.lit(" is the parent of "), "path")),
        edge(1, "contains", F.col("parent"), F.col("child"), F.concat("above", F.lit(" contains "), "path")),
        F.when(F.col("after").isNotNull(), edge(2, "next_sibling", F.col("child"), F.col("after"), F.concat("after_path", F.lit(" follows "), "path"))),
    )
    edges = rows.select("document_id", "source_path", "above", "idx", F.explode(F.array_compact(three)).alias("e"))
    return edges.select(
        "document_id", F.array(F.lit(0), "idx", "e.n").alias("seq"), stable_id("document_id", "e.src", "e.tgt", "e.relation", prefix="edge-").alias("id"),
        "e.src", "e.tgt", F.col("e.relation").alias("relation_type"), F.col("e.text").alias("description"), F.lit("structural").alias("edge_source"),
        F.lit("").alias("evidence_span"), F.lit("structural").alias("evidence_status"), F.lit("valid").alias("ontology_status"),
        F.lit(1.0).alias("confidence"), F.col("above").alias("tree_path"), "source_path", meta().alias("metadata"),
    ).select(*EDGE_COLUMNS)
