"""Merging of nodes that mean the same, and of the edges between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import merge_lines, normalize_key, stable_id, strip
from graphloom.operators.ends import beside
from graphloom.operators.metadata import with_fields
from graphloom.operators.structural import EDGE_COLUMNS, NODE_COLUMNS


def cluster_id() -> Column:
    """Structural nodes keep their id; semantic ones share one by type and normalised name."""
    key = normalize_key(F.concat("entity_type", F.lit(":"), "name"))
    return F.when(F.col("kind") == "structural", F.col("id")).otherwise(stable_id("document_id", key, prefix="ent-"))


def _merged(members: str, field: str, n: str) -> Column:
    """A field over a group: as it is for one row, else its distinct lines in order."""
    texts = F.transform(members, lambda m: m[field])
    return F.when(F.col(n) == 1, F.get(texts, 0)).otherwise(merge_lines(texts))


def cluster_nodes(nodes: DataFrame, clustered: bool = False) -> DataFrame:
    """One node for each cluster: the first row's fields, with texts and names merged. ``clustered``: ids are those of clusters."""
    rows = nodes.withColumn("cluster", F.col("id") if clustered else cluster_id())
    member = F.struct("seq", "description", "evidence_span", "name", "kind")
    wide = ("tree_path", "source_path", "source_trace_id", "metadata")  # of their own, so that they can be left out
    few = [c for c in NODE_COLUMNS if c not in ("document_id", "id", "description", "evidence_span", *wide)]
    grouped = rows.groupBy("document_id", "cluster").agg(
        F.min_by(F.struct(*few), "seq").alias("row"), F.min_by(F.struct(*wide), "seq").alias("wide"), F.sort_array(F.collect_list(member)).alias("members"), F.count(F.lit(1)).alias("n")
    )
    named = F.transform(F.filter("members", lambda m: m["kind"] != "structural"), lambda m: F.when(m["seq"] == F.col("row.seq"), strip(m["name"])).otherwise(m["name"]))
    merged = {
        "id": F.col("cluster"),
        "name": strip(F.col("row.name")),
        "description": _merged("members", "description", "n"),
        "evidence_span": _merged("members", "evidence_span", "n"),
        "metadata": with_fields(F.col("wide.metadata"), mentions=F.array_distinct(named)),
    }
    return grouped.select(*(merged.get(c, F.col("document_id") if c == "document_id" else F.col(f"{'wide' if c in wide else 'row'}.{c}")).alias(c) for c in NODE_COLUMNS))


def merge_edges(edges: DataFrame, nodes: DataFrame | None, together: bool = False) -> DataFrame:
    """Edges between clusters: ends renamed, loops dropped, equal ones merged with the highest confidence.

    ``nodes`` are the nodes before clustering, None if ends bear their clusters' ids already.
    An id with several clusters takes that of its last row; an unknown end keeps its id.
    ``together``: both tables are dealt alike by document_id, and rows stay where they are.
    """
    return _merged_edges(edges if nodes is None else _renamed(edges, nodes, together))


def _renamed(edges: DataFrame, nodes: DataFrame, together: bool) -> DataFrame:
    ids = nodes.withColumn("cluster", cluster_id()).groupBy("document_id", "id").agg(F.max_by("cluster", "seq").alias("cluster")).where("cluster <> id")
    renamed = beside(edges, ids, "cluster", together)
    return renamed.withColumns({end: F.coalesce(f"{end}_cluster", end) for end in ("src", "tgt")}).select(*EDGE_COLUMNS)


def _merged_edges(renamed: DataFrame) -> DataFrame:
    rows = renamed.where("src <> tgt")
    key = ["document_id", "src", "tgt", "relation_type", "edge_source"]
    member = F.struct("seq", "description", "evidence_span")
    own = {*key, "confidence"}
    wide = ("tree_path", "source_path", "metadata")
    few = [c for c in EDGE_COLUMNS if c not in own.union(("id", "description", "evidence_span"), wide)]
    grouped = rows.groupBy(*key).agg(
        F.min_by(F.struct(*few), "seq").alias("row"), F.min_by(F.struct(*wide), "seq").alias("wide"), F.sort_array(F.collect_list(member)).alias("members"), F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence")
    )
    merged = {
        "id": stable_id(*key, prefix="edge-"),
        "description": _merged("members", "description", "n"),
        "evidence_span": _merged("members", "evidence_span", "n"),
    }
    return grouped.select(*(merged.get(c, F.col(c) if c in own else F.col(f"{'wide' if c in wide else 'row'}.{c}")).alias(c) for c in EDGE_COLUMNS))
