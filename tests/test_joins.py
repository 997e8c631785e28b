"""Joins whose small files grow into large texts: none of it goes through the driver."""

from pyspark.sql import functions as F

from graphloom.operators import llm
from graphloom.operators.metadata import meta


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _asked(spark):
    rows = spark.range(20).select(F.lit("d").alias("document_id"), F.concat(F.lit("c"), "id").alias("chunk_id"), F.col("id").cast("int").alias("idx"))
    chunks = rows.select("*", F.lit("s").alias("source_path"), F.lit(1).alias("piece_idx"), F.lit("n").alias("node_id"), F.lit("text").alias("node_type"), F.lit("root").alias("tree_path"), F.concat(F.lit("The  part "), "idx").alias("content"), meta().alias("metadata"))
    entity = lambda name: F.concat(F.lit(f'("entity"<|>{name} '), "idx", F.lit("<|>component<|>x<|>PART "), "idx", F.lit(")##"))
    relation = F.concat(F.lit('("relationship"<|>a '), "idx", F.lit("<|>b "), "idx", F.lit("<|>affects<|>d<|>part "), "idx", F.lit("<|>0.9)"))
    return chunks, rows.select("document_id", "chunk_id", F.concat(entity("a"), entity("b"), relation).alias("response"))


def test_answers_and_chunks_are_not_broadcast(spark):
    chunks, answers = _asked(spark)
    found = llm.llm_entities(chunks, answers)
    related = llm.llm_relations(chunks, found, answers)
    prompts = llm.relation_prompts(chunks, found)
    assert not [t for t in (found, related, prompts) if "Broadcast" in _plan(t)]
    assert (found.count(), related.count(), prompts.count()) == (40, 20, 20)


def test_published_texts_stay_in_tasks(spark, tmp_path, monkeypatch):
    """No text of a graph meets its row in a join, and an index is read by its lines."""
    from graphloom.plans import publish as published
    from graphloom.plans.build import build
    from graphloom.plans.store import export_files
    from graphloom.sources.documents import from_table
    from graphloom.sources.graphs import graphs_at, index_entries, index_lines, read_graphs

    graph = build(from_table(spark.range(5), F.concat(F.lit("n\n{,"), "id"), F.lit("# A\n\nDRAM and ECC.\n"), "notes"))
    export_files(graph, str(tmp_path / "work"), zipped=True)
    plans, put = [], published.put_texts
    monkeypatch.setattr(published, "put_texts", lambda rows: plans.append(_plan(rows)) or put(rows))
    index = published.publish(spark, str(tmp_path / "work"), str(tmp_path / "public"), zipped=True)["index_path"]
    assert len(plans) == 1 and "Join" not in plans[0]
    whole = index_entries(spark.read.text(index, wholetext=True).withColumnRenamed("value", "content"))
    listed = index_entries(index_lines(spark, index))
    assert sorted(listed.collect()) == sorted(whole.collect()) and listed.count() == 5
    read = graphs_at(listed.select(F.concat(F.lit(f"{tmp_path}/public/kg/"), "path", F.lit(".gz")).alias("path")))
    rows = lambda t: sorted(map(str, t.select("document", "nodes", "edges", "review", "stats").collect()))
    assert rows(read) == rows(read_graphs(spark, f"{tmp_path}/public/kg/*/graph.json.gz")) and len(rows(read)) == 5
