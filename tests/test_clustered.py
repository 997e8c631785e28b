"""Candidates that bear their clusters' ids, and batches of a store that are written in one pass."""

from pyspark.sql import functions as F

from graphloom.operators.blocks import components
from graphloom.operators.chunks import chunks
from graphloom.operators.heuristic import chunk_mentions, each_mention, entity_nodes, mention_edges, pair_edges
from graphloom.operators.normalize import cluster_nodes, merge_edges
from graphloom.operators.tree import tree_nodes
from graphloom.plans.build import build
from graphloom.plans.store import persist, stored
from graphloom.scratch import written
from graphloom.sources.documents import from_table

_ODD = "# A\n\nDRAM dram ecc ECC on 12 nm, 12  NM Process and 5 µm, ٣ GB or 3 GB; 1.2V, 1.2 v, PHY_phy, bank, BANK, CAS latency, cas latency.\n\n## B\n\nbase die DIE die copper 7% 7 % ſilicon PCIe-pcie"


def _rows(df):
    return sorted(map(str, df.select([c for c in df.columns if c != "id"]).collect()))


def test_ids_of_clusters_from_the_start_give_the_same_graph(spark):
    documents = from_table(spark.range(3), F.col("id"), F.lit(_ODD), "odd")
    found = written(chunk_mentions(chunks(written(tree_nodes(documents, components(documents)), "tree"))), "mentions")
    m = each_mention(found)
    nodes, clustered = entity_nodes(m), entity_nodes(m, clustered=True)
    assert _rows(cluster_nodes(clustered, clustered=True)) == _rows(cluster_nodes(nodes)) and nodes.count() > 40
    ids = lambda t: sorted(r.id for r in t.select("id").collect())
    assert ids(cluster_nodes(clustered, clustered=True)) == ids(cluster_nodes(nodes))
    plain = merge_edges(mention_edges(m).unionByName(pair_edges(found)), nodes)
    merged = merge_edges(mention_edges(m, clustered=True).unionByName(pair_edges(found, clustered=True)), None)
    assert _rows(merged) == _rows(plain) and ids(merged) == ids(plain)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan  # each end of each edge was looked for before


def test_a_batch_is_written_in_one_pass_unless_ids_or_ends_are_odd(spark, tmp_path, monkeypatch):
    from graphloom.plans import store

    asked = []
    for name in ("entity_table", "relation_table"):
        monkeypatch.setattr(store, name, lambda *a, name=name, f=getattr(store, name): asked.append(name) or f(*a))
    g = build(from_table(spark.range(2), F.col("id"), F.lit("# A\n\nDRAM and ECC.\n"), "notes"))
    persist(g, str(tmp_path / "plain"))
    assert not asked
    later = g.nodes.withColumns({"seq": F.array(F.lit(9)), "name": F.lit("later")})
    gone = F.col("name") != "ECC"
    persist(g._replace(nodes=g.nodes.where(gone).unionByName(later.where("entity_type = 'memory_product'"))), str(tmp_path / "odd"))
    assert asked == ["entity_table", "relation_table"]
    at = lambda name, table: stored(spark, str(tmp_path / name), table)
    assert at("odd", "entity").where("name = 'later'").count() == 2 == at("plain", "entity").where("entity_type = 'memory_product'").count()
    assert at("odd", "entity").count() == at("plain", "entity").count() - 2
    ends = at("plain", "relation").join(g.nodes.where(~gone).select("document_id", F.col("id").alias("tgt")), ["document_id", "tgt"], "left_anti")
    assert at("odd", "relation").count() == ends.count() < at("plain", "relation").count()
