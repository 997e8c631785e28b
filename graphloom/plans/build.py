"""Documents to validated graphs."""

from __future__ import annotations

import functools
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.blocks import components
from graphloom.operators.chunks import OVERLAP, SIZE, chunks
from graphloom.operators.ends import DEALT, dealt
from graphloom.operators.heuristic import chunk_mentions, each_mention, entity_nodes, mention_edges, pair_edges
from graphloom.operators.normalize import cluster_nodes, merge_edges
from graphloom.operators.structural import structural_edges, structural_nodes
from graphloom.operators.tree import tree_nodes
from graphloom.operators.validate import MIN_CONFIDENCE, graph_stats, judge_edges, judge_nodes
from graphloom.plans.schema import Ontology
from graphloom.scratch import owned, written


class Graph(NamedTuple):
    """Judged nodes and edges (valid ones have no review reasons) with what they come from."""

    documents: DataFrame
    tree: DataFrame
    chunks: DataFrame
    nodes: DataFrame
    edges: DataFrame
    stats: DataFrame

    def valid(self, table: str) -> DataFrame:
        return getattr(self, table).where("size(review_reasons) = 0").drop("review_reasons")

    def review(self, table: str) -> DataFrame:
        return getattr(self, table).where("size(review_reasons) > 0")


def candidates(tree: DataFrame, found: DataFrame) -> list[tuple[DataFrame, DataFrame, int | None]]:
    """Candidate nodes and edges of a stored tree and its stored mentions, each with the number of parts that ``dealt`` tells.

    Mentions stand one in a row or, as ``chunk_mentions`` has them, as an array. Entities bear
    their clusters' ids from the start, so that no edge has to look for those of its ends.
    """
    return [_grown(*tables, parts) for tables, parts in _dealt(tree, found)]


def _dealt(tree: DataFrame, found: DataFrame) -> list[tuple[list[DataFrame], int | None]]:
    return dealt([tree, found], weights=[F.lit(1), F.size("told") if "told" in found.columns else F.lit(1)])


def _grown(tree: DataFrame, found: DataFrame, parts: int | None) -> tuple[DataFrame, DataFrame, int | None]:
    m = each_mention(found) if "told" in found.columns else found
    edges = structural_edges(tree).unionByName(mention_edges(m, clustered=True)).unionByName(pair_edges(found, clustered=True))
    return structural_nodes(tree).unionByName(entity_nodes(m, clustered=True)), edges, parts


def extracted(documents: DataFrame, split_text: bool = False, split_paragraphs: bool = False, size: int = SIZE, overlap: int = OVERLAP) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame, int | None]]]:
    """The documents' trees, stored and dealt by document, and their ``candidates``; what was stored on the way goes."""
    spark = documents.sparkSession
    with owned() as steps:
        tree = written(tree_nodes(documents, components(documents)), "tree")
        steps.clear(spark, but="tree")
        parts = _dealt(tree, written(chunk_mentions(chunks(tree, split_text, split_paragraphs, size, overlap)), "mentions"))
    steps.clear(spark, but=DEALT)
    return functools.reduce(DataFrame.unionByName, [t for (t, _), _ in parts]), [_grown(*tables, n) for tables, n in parts]


def _judged(nodes: DataFrame, edges: DataFrame, parts: int | None, ontology: Ontology, min_confidence: float, keep: bool = True, clustered: bool = True) -> tuple[DataFrame, DataFrame]:
    """Merged and validated nodes and edges, stored if ``keep``; with ``parts`` candidates stand together by document.

    ``clustered``: nodes and ends of edges bear the ids of their clusters.
    """
    together = parts is not None
    judged_nodes = judge_nodes(cluster_nodes(nodes, clustered), ontology)
    merged = merge_edges(edges, None if clustered else nodes, together)
    if not keep:
        return judged_nodes, judge_edges(merged, judged_nodes, ontology, min_confidence, together)
    judged_nodes = written(judged_nodes, "judged-nodes")
    near = judged_nodes.repartition(parts, "document_id") if together else judged_nodes
    return judged_nodes, written(judge_edges(merged, near, ontology, min_confidence, together), "judged-edges")


def finish(documents: DataFrame, tree: DataFrame, pieces: DataFrame, nodes: DataFrame, edges: DataFrame, ontology: Ontology = Ontology(), min_confidence: float = MIN_CONFIDENCE) -> Graph:
    """Adds the structural graph to candidate nodes and edges, merges and validates all."""
    all_nodes = written(structural_nodes(tree).unionByName(nodes), "nodes")
    judged_nodes, judged_edges = _judged(all_nodes, structural_edges(tree).unionByName(edges), None, ontology, min_confidence, clustered=False)
    return Graph(documents, tree, pieces, judged_nodes, judged_edges, graph_stats(documents, judged_nodes, judged_edges))


def build(
    documents: DataFrame, split_text: bool = False, split_paragraphs: bool = False, size: int = SIZE, overlap: int = OVERLAP,
    ontology: Ontology = Ontology(), min_confidence: float = MIN_CONFIDENCE, keep: bool = True,
) -> Graph:
    """The graphs of all documents by pattern extraction.

    Trees and mentions are written once to the shared folder, and dealt from there by
    document_id before they grow into nodes and edges: all later steps run where rows are.
    Nodes and edges are far larger; without ``keep`` they are not stored, each use makes
    those rows and columns that it needs, and edges cost nothing where nodes alone are used.
    """
    tree, grown = extracted(documents, split_text, split_paragraphs, size, overlap)
    pieces = chunks(tree, split_text, split_paragraphs, size, overlap)
    judged = [_judged(*c, ontology, min_confidence, keep) for c in grown]
    judged_nodes, judged_edges = (functools.reduce(DataFrame.unionByName, rows) for rows in zip(*judged, strict=True))
    return Graph(documents, tree, pieces, judged_nodes, judged_edges, graph_stats(documents, judged_nodes, judged_edges))
