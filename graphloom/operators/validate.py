"""Validation against the ontology: what is grounded and known is valid, the rest goes to review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import strip
from graphloom.operators.ends import beside
from graphloom.plans.schema import ASSETS, Ontology

MIN_CONFIDENCE = 0.5


def _reasons(**failed: Column) -> Column:
    """The names of the conditions that hold, in the order given."""
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in failed.items())))


def _filled(array: Column) -> Column:
    return F.size(F.coalesce(array, F.array().cast("array<string>"))) > 0


def judge_nodes(nodes: DataFrame, ontology: Ontology = Ontology()) -> DataFrame:
    """Adds ``review_reasons`` and sets the statuses; a node without reasons is valid."""
    m, evidence = F.col("metadata"), strip("evidence_span") != ""
    shown = (F.coalesce(m["img_path"], F.lit("")) != "") | (F.coalesce(m["table_body"], F.lit("")) != "") | _filled(m["image_caption"]) | _filled(m["table_caption"])
    grounded = (F.col("kind") == "structural") | evidence | (F.col("modality").isin(*ASSETS) & shown)
    known = F.coalesce(F.col("entity_type").isin(*ontology.entity_types), F.lit(False))
    judged = nodes.withColumn("review_reasons", _reasons(unknown_entity_type=~known, missing_evidence=~grounded))
    assumed = F.when(F.col("modality") != "text", "asset_grounded").otherwise("grounded")
    return _with_statuses(judged, assumed)


def judge_edges(edges: DataFrame, judged_nodes: DataFrame, ontology: Ontology = Ontology(), min_confidence: float = MIN_CONFIDENCE, together: bool = False) -> DataFrame:
    """Adds ``review_reasons`` and sets the statuses; both ends must be valid nodes of the document.

    ``together``: both tables are dealt alike by document_id, and rows stay where they are.
    """
    valid = judged_nodes.where(F.size("review_reasons") == 0).select("document_id", "id").distinct().withColumn("valid", F.lit(True))
    rows = beside(edges, valid, "valid", together)
    has_ends = F.col("src_valid").isNotNull() & F.col("tgt_valid").isNotNull()
    grounded = (F.col("edge_source") == "structural") | (strip("evidence_span") != "")
    known = F.coalesce(F.col("relation_type").isin(*ontology.relation_types), F.lit(False))
    low = F.coalesce((F.col("confidence") < min_confidence) & ~F.isnan("confidence"), F.lit(False))
    reasons = _reasons(missing_valid_endpoint=~has_ends, unknown_relation_type=~known, low_confidence=low, missing_evidence=~grounded)
    judged = rows.withColumn("review_reasons", reasons).select(*edges.columns, "review_reasons")
    assumed = F.when(F.col("edge_source") == "structural", "structural").otherwise("grounded")
    return _with_statuses(judged, assumed)


def _with_statuses(judged: DataFrame, assumed: Column) -> DataFrame:
    rejected = F.size("review_reasons") > 0
    missing = F.array_contains("review_reasons", "missing_evidence")
    evidence = F.when(missing, "missing").when(~rejected & (F.col("evidence_status") == "missing"), assumed).otherwise(F.col("evidence_status"))
    return judged.withColumns({"ontology_status": F.when(rejected, "rejected").otherwise("valid"), "evidence_status": evidence})


def graph_stats(documents: DataFrame, judged_nodes: DataFrame, judged_edges: DataFrame) -> DataFrame:
    """(document_id, node_count, edge_count, review_node_count, review_edge_count) of every document."""
    count = lambda rows, name: rows.groupBy("document_id").agg(
        F.count_if(F.size("review_reasons") == 0).alias(f"{name}_count"), F.count_if(F.size("review_reasons") > 0).alias(f"review_{name}_count")
    ).hint("merge")
    out = documents.select("document_id").join(count(judged_nodes, "node"), "document_id", "left").join(count(judged_edges, "edge"), "document_id", "left")
    names = ("node_count", "edge_count", "review_node_count", "review_edge_count")
    return out.select("document_id", *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names))
