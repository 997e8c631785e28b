"""Sources, sinks, queries, model answers and streaming."""

import json
import os
import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from graphloom.operators import graph_query as gq
from graphloom.operators import llm
from graphloom.operators.metadata import meta
from graphloom.plans.build import build
from graphloom.plans.run import build_with_model, config_of, run
from graphloom.plans.publish import publish
from graphloom.plans.store import Log, clear, compact, export_files, export_json, persist, stored, stored_stats
from graphloom.scratch import entries
from graphloom.sources.config import BuildConfig, config_from
from graphloom.sources.documents import load_documents, read_manifest, read_markdown, read_markdown_folder
from graphloom.sources.graphs import discover_exports, graph_table, index_entries, local_entries, read_graphs
from graphloom.streaming.ingest import document_stream, ingest

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks cannot import this module
DOCUMENT = "document_id string, document_name string, source_path string, content string"
TEXT = "# Chip\nLPDDR5X supports 8533 MT/s.\n\n## Die\nThe die uses ECC and silicon.\n"


def markdown(spark, *texts):
    return spark.createDataFrame([(f"doc-{i}", f"d{i}", f"/data/d{i}.md", t) for i, t in enumerate(texts)], DOCUMENT)


def test_configs():
    full = config_from({"input": "a.md", "tree": {"split_text_nodes": True}, "extraction": {"extractor": "llm", "batch_size": "8"}, "llm": {"model": "m", "temperature": "0.5"}})
    assert full == BuildConfig("a.md", split_text_nodes=True, extractor="llm", llm_batch_size=8, llm_model="m", llm_temperature=0.5)
    plain = config_from({"input_path": "b.md", "extraction": {"batch_size": -1}})
    assert plain.llm_temperature is None and plain.llm_batch_size == 16
    for broken in ({}, [], {"input": "a", "export": "xml"}, {"input": "a", "extraction": {"extractor": "llm"}}):
        with pytest.raises(ValueError):
            config_from(broken)


def test_command_line(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"input": "x.md", "llm": {"model": "m"}, "tree": {"split_text_nodes": True}}))
    with pytest.raises(SystemExit):
        config_of([])
    assert config_of(["--config", str(tmp_path / "c.json"), "--input", "y.md", "--llm-batch-size", "3"]) == BuildConfig("y.md", split_text_nodes=True, llm_model="m", llm_batch_size=3)
    (tmp_path / "a.md").write_text(TEXT)
    lines = run(spark, config_of(["--input", str(tmp_path / "a.md"), "--working-dir", str(tmp_path / "w"), "--split-text-to-paragraphs"]))
    lines = [r.value for r in lines.collect()]
    assert len(lines) == 1 and lines[0].startswith("a: 10 nodes, ") and discover_exports(spark, str(tmp_path / "w"))


def test_markdown_and_manifest(spark, tmp_path):
    at = tmp_path / "my note+1.md"
    at.write_text(TEXT)
    row = read_markdown(spark, str(at)).first()
    assert (row.document_name, row.source_path, row.content) == ("my note+1", str(at), TEXT) and row.document_id.startswith("doc-")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b c+é.md").write_text(TEXT)
    whole = read_markdown_folder(spark, str(tmp_path / "in")).first()
    assert whole == read_markdown(spark, str(tmp_path / "in" / "b c+é.md")).first()
    manifest = tmp_path / "m.json"
    manifest.write_text(json.dumps({"paper-a": str(at), "paper-b": str(at)}))
    rows = load_documents(spark, str(manifest)).collect()
    assert {r.document_name for r in rows} == {"paper-a", "paper-b"} and {r.source_path for r in rows} == {str(at)}
    (tmp_path / "x.txt").write_text("x")
    for call in (lambda: read_markdown(spark, str(tmp_path / "x.txt")), lambda: load_documents(spark, "x.csv"), lambda: read_manifest(spark, str(at))):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(FileNotFoundError):
        read_markdown(spark, str(tmp_path / "none.md"))


def test_store_export_publish_and_read_back(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.md").write_text(TEXT)
    (tmp_path / "m.json").write_text(json.dumps({n: str(tmp_path / f"{n}.md") for n in ("a", "b")}))
    g = build(load_documents(spark, str(tmp_path / "m.json")))
    for _ in range(2):  # writing again replaces
        persist(g, str(tmp_path / "store"))
    stats = {r.document_id: r for r in g.stats.collect()}
    for r in stored_stats(spark, str(tmp_path / "store")).collect():
        assert (r.stored_node_count, r.stored_edge_count) == (stats[r.document_id].node_count, stats[r.document_id].edge_count)
    files = [r.export_path for r in export_files(g, str(tmp_path / "work")).orderBy("document_name").collect()]
    assert len(files) == 2 and sorted(discover_exports(spark, str(tmp_path / "work"))) == sorted(files)
    graph = json.loads(open(files[0]).read())
    assert graph["tree"]["children"][0]["children"][1]["children"][0]["node_type"] == "text"
    assert graph["stats"]["node_count"] == len(graph["nodes"]) and graph["ontology"]["entity_types"][0] == "FORMULA"
    assert set(json.loads((tmp_path / "work" / "index.json").read_text())) == {"a", "b"}
    assert publish(spark, str(tmp_path / "work"), str(tmp_path / "public"))["graph_count"] == 2
    (tmp_path / "work" / "index").rename(tmp_path / "elsewhere")  # a folder without an index table is looked through
    assert publish(spark, str(tmp_path / "work"), str(tmp_path / "public"))["graph_count"] == 2
    index = json.loads((tmp_path / "public" / "kg" / "index.json").read_text())
    assert set(index) == {"a", "b"} and all((tmp_path / "public" / "kg" / e["graph_path"]).read_text() for e in index.values())
    (tmp_path / "work" / "index.json").write_text(json.dumps({"x": {"export_path": files[0]}, "y": {"export_path": "none.json"}, "z": 3, "w": {"document_id": files[1].split("/")[-3]}}))
    assert discover_exports(spark, str(tmp_path / "work")) == files
    (tmp_path / "work" / "index.json").unlink()
    assert discover_exports(spark, str(tmp_path / "work")) == sorted(files)
    export_json(g, str(tmp_path / "lines"))
    assert read_graphs(spark, str(tmp_path / "lines"), lines=True).count() == 2
    empty = build(spark.createDataFrame([(r.document_id, r.document_name, r.source_path, "") for r in g.documents.collect()[:1]], g.documents.schema))
    persist(empty, str(tmp_path / "store"))
    left = {r.document_id: r.stored_edge_count for r in stored_stats(spark, str(tmp_path / "store")).collect()}
    again = empty.documents.first().document_id
    assert left[again] == 0 and left.keys() == stats.keys() and stored(spark, str(tmp_path / "store"), "entity").where(F.col("document_id") == again).count() == 1
    clear(empty.documents, str(tmp_path / "store"))
    assert {r.document_id for r in stored_stats(spark, str(tmp_path / "store")).collect()} == stats.keys() - {again}
    loaded = read_graphs(spark, files)
    assert graph_table(loaded, "nodes").count() == sum(s.node_count for s in stats.values())
    (tmp_path / "bad.json").write_text('{"document": {"document_id": "x"}, "nodes": []}')
    with pytest.raises(Exception, match="needs a document id"):
        read_graphs(spark, str(tmp_path / "bad.json")).collect()
    with pytest.raises(FileNotFoundError):
        publish(spark, str(tmp_path / "nothing"), str(tmp_path / "public"))


def test_index_paths(spark):
    index = {"a": "u.json", "b": {"graph_url": "g"}, "c": {"graph_path": "p", "document_id": "d"}, "d": {"document_id": "d", "export_path": "/kg/e"}, "e": {"export_path": "/kg/e"}, "f": {"export_path": "/tmp/e"}}
    rows = spark.createDataFrame([(1, "/x/index.json", json.dumps(index)), (2, "/x/index.json", json.dumps(list(index.values()))), (3, "/x/index.json", "{}")], "n int, index_path string, content string")
    got = {(r.n, r.name): r.path for r in index_entries(rows).collect()}
    want = ["u.json", "g", "p", "d/graph.json", "/kg/e"]
    assert [got[1, k] for k in "abcdef"] == [*want, "f/graph.json"] and [got[2, str(i)] for i in range(6)] == [*want, "5/graph.json"] and len(got) == 12
    local = {(r.n, r.name): r.path for r in local_entries(rows).collect()}
    assert [local[1, k] for k in "abcdef"] == ["/x/u.json", "/x/b/exports/graph.json", "/x/p", "/kg/e", "/kg/e", "/tmp/e"]
    with pytest.raises(Exception, match="must be absolute"):
        local_entries(rows.withColumn("index_path", F.lit("index.json"))).collect()


def test_run_and_publish_many_documents(spark, tmp_path):
    folder, n = tmp_path / "in", 1200
    folder.mkdir()
    for i in range(n):
        (folder / f"n{i}.md").write_text(f"# Note {i}\n")
    (tmp_path / "m.json").write_text(json.dumps({f"n{i}": str(folder / f"n{i}.md") for i in range(n)}))
    lines = run(spark, BuildConfig(str(tmp_path / "m.json"), working_dir=str(tmp_path / "w")))
    assert lines.count() == n
    assert publish(spark, str(tmp_path / "w"), str(tmp_path / "public"))["graph_count"] == n
    index = json.loads((tmp_path / "public" / "kg" / "index.json").read_text())
    assert len(index) == n and json.loads((tmp_path / "public" / "kg" / index["n7"]["graph_path"]).read_text())["document"]["document_name"] == "n7"


def test_graph_queries(spark):
    documents = spark.createDataFrame([("d", "n", "/s.md", TEXT)], "document_id string, document_name string, source_path string, content string")
    g = build(documents, min_confidence=0.7)
    assert [r.name for r in gq.search(g.nodes, "lpd").collect()] == ["LPDDR5X"] and gq.search(g.nodes, "  ").count() == 0
    nodes, edges = gq.subgraph(g.nodes, g.edges, ["component", "material"], ["part_of", "contains"])
    assert edges.where("relation_type = 'part_of'").count() == 1
    review_nodes, review_edges = gq.subgraph(g.nodes, g.edges, review_only=True)
    assert review_edges.count() == g.review("edges").count() > 0 and review_nodes.where("is_review").count() == 0
    near, at = gq.neighborhood(g.nodes, g.edges, F.col("name") == "LPDDR5X")
    assert {r.name for r in near.collect()} >= {"LPDDR5X", "8533 MT/s"} and at.count() == 2
    ends, _ = gq.edge_ends(g.nodes, g.edges, F.col("relation_type") == "part_of")
    assert ends.count() == 2
    assert gq.combined(g.nodes).count() == g.nodes.count()
    assert gq.active_document(documents).first().document_id == "d" and gq.active_document(documents, "zz").first().document_id == "d"
    assert {r.entity_type for r in gq.types(g.nodes, "entity_type").collect()} >= {"component", "material"}
    assert gq.edge_elements(g.edges).where("review").count() == g.review("edges").count()


class Fake:
    async def generate(self, prompt, *, image_data_url=None):
        if "BROKEN ENTITY" in prompt:
            raise RuntimeError("entity")
        if image_data_url is not None:
            assert image_data_url.startswith("data:image/png;base64,")
        if "List the technical entities" in prompt:
            return '("entity"<|>"LPDDR5X"<|>"memory_product"<|>"A product"<|>"LPDDR5X supports")##("entity"<|>8533 MT/s<|>Performance Metric<|>rate<|>8533  mt/s)##("entity"<|>Ghost<|>component<|>x<|>not there)<|COMPLETE|>'
        if "BROKEN RELATION" in prompt:
            raise RuntimeError("relation")
        return '("relationship"<|>lpddr5x<|>8533 MT/s<|>has bandwidth<|>d<|>LPDDR5X supports 8533 MT/s<|>nan)<|COMPLETE|>'


def test_model_extraction_without_network(spark, tmp_path):
    texts = ["LPDDR5X supports 8533 MT/s.", "BROKEN ENTITY LPDDR5X supports", "BROKEN RELATION LPDDR5X supports ８５３３ MT/s", "nothing to see"]
    documents = spark.createDataFrame([(f"d{i}", "n", "/s.md", t) for i, t in enumerate(texts)], "document_id string, document_name string, source_path string, content string")
    g = build_with_model(documents, Fake, str(tmp_path))
    names = {}
    for r in g.nodes.where("kind = 'semantic'").collect():
        names.setdefault(r.document_id, set()).add(r.name)
    assert names == {"d0": {"LPDDR5X", "8533 MT/s"}, "d2": {"LPDDR5X", "8533 MT/s"}}
    relations = g.edges.where("relation_type = 'has_bandwidth'").collect()
    assert [(r.document_id, r.confidence) for r in relations] == [("d0", 1.0)]


def test_images_reach_the_model(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"png")
    rows = spark.createDataFrame([("d", c, "List the technical entities", p) for c, p in (("c", str(tmp_path / "a.png")), ("e", str(tmp_path / "none.png")), ("f", None))], "document_id string, chunk_id string, prompt string, image_path string")
    shown = {r.chunk_id: r for r in llm.with_images(rows, llm.image_table(spark, [str(tmp_path)])).collect()}
    assert shown["c"].image_data_url == "data:image/png;base64,cG5n" and shown["c"].image_error is None
    assert shown["e"].image_data_url is None and shown["e"].image_error == f"no image at {tmp_path}/none.png" and shown["f"].image_error is None
    assert llm.ask(llm.with_images(rows, llm.image_table(spark, [str(tmp_path)])), Fake).where("error IS NOT NULL").count() == 0
    many = llm.with_images(spark.createDataFrame([("d", f"c{i}", "x", None) for i in range(12)], rows.schema), None)
    began = time.monotonic()
    assert llm.ask(many, Fake, batch=2, tasks=2, per_second=12).count() == 12 and time.monotonic() - began > 0.5
    with pytest.raises(ValueError):
        llm.ask(many, Fake, per_second=1)
    with pytest.raises(ValueError):
        llm.ChatClient("m")
    assert "temperature" not in llm.ChatClient("m", "k").payload("p") and llm.ChatClient("m", "k", temperature=0.1).payload("p", "u")["messages"][0]["content"][1]["image_url"]["url"] == "u"


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text(TEXT)
    query = ingest(document_stream(spark, str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "check"), availableNow=True)
    query.awaitTermination(120)
    assert stored_stats(spark, str(tmp_path / "store")).first().stored_node_count > 5
    assert spark.range(1).select(meta().alias("m")).first().m.mentions is None


def test_writers_at_a_time_and_compaction(spark, tmp_path):
    import threading

    path = str(tmp_path / "store")
    g = build(markdown(spark, *[TEXT] * 4))
    some = lambda *names: g._replace(documents=g.documents.where(F.col("document_name").isin(*names)), **{t: getattr(g, t).join(g.documents.where(F.col("document_name").isin(*names)).select("document_id"), "document_id", "left_semi") for t in ("nodes", "edges")})
    persist(g, path)
    threads = [threading.Thread(target=persist, args=(some(n), path)) for n in ("d0", "d1", "d2")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    log = Log(spark, path)
    assert log.batches() == [0, 2, 4, 6]
    before = sorted(map(tuple, stored(spark, path, "entity").collect()))
    assert log.claim() == 4  # never done
    clear(g.documents.where("document_name = 'd3'"), path)
    assert compact(spark, path) == 4 and log.batches() == [7, 10]
    assert compact(spark, path, patience=0) == 2 and log.batches() == [11]
    assert not [n for n in entries(spark, f"{path}/entity") if n != "batch=11"]
    ids = {r.document_id for r in stored(spark, path, "document").collect()}
    assert sorted(map(tuple, stored(spark, path, "entity").collect())) == [r for r in before if r[0] in ids] and len(ids) == 3
    assert compact(spark, path) == 0
    assert compact(spark, str(tmp_path / "none")) == 0 and stored(spark, str(tmp_path / "none"), "entity").count() == 0


def test_a_stream_is_stored_once_and_only_changes_are_built(spark, tmp_path, monkeypatch):
    from graphloom.streaming import ingest as module

    path, built = str(tmp_path / "store"), []
    monkeypatch.setattr(module, "build", lambda rows: built.append(sorted(r.document_name for r in rows.collect())) or build(rows))
    batch = markdown(spark, TEXT, TEXT + "more DRAM\n", "# Other\n")
    assert module.store_batch(batch, 0, path, "s") and not module.store_batch(batch.withColumn("content", F.lit("x")), 0, path, "s")
    changed = batch.withColumn("content", F.when(F.col("document_name") == "d1", "# Changed\nSRAM\n").otherwise(F.col("content")))
    assert module.store_batch(changed, 1, path, "s") and module.store_batch(batch.limit(0), 2, path, "s") and module.store_batch(batch.limit(1), 0, path, "other")
    assert built == [["d0", "d1", "d2"], ["d1"], [], []]
    compact(spark, path)
    assert Log(spark, path).streams() == {"s": 2, "other": 0} and not module.store_batch(batch, 2, path, "s")
    assert stored(spark, path, "entity").where("name = 'SRAM'").count() == 1 and stored(spark, path, "entity").where("name = 'DRAM'").count() == 0


class Counting:
    """Fails until a file is there, and notes each prompt it is asked."""

    def __init__(self, folder):
        self.folder = folder

    async def generate(self, prompt, *, image_data_url=None):
        with open(f"{self.folder}/asked", "a") as asked:
            asked.write(prompt + "\n")
        if prompt.startswith("bad") and not os.path.exists(f"{self.folder}/mended"):
            raise RuntimeError("not yet")
        return prompt.upper()


def test_answers_are_asked_once(spark, tmp_path):
    prompts = spark.createDataFrame([("d", f"c{i}", p, None) for i, p in enumerate(["one", "two", "bad", "one", "three"])], "document_id string, chunk_id string, prompt string, image_path string")
    folder, store = str(tmp_path), str(tmp_path / "answers")
    asked = lambda: sorted((tmp_path / "asked").read_text().split())
    ask = lambda rows, **how: {r.chunk_id: (r.response, r.error) for r in llm.answered(llm.with_images(rows, None), lambda: Counting(folder), store, "m", **how).collect()}
    assert ask(prompts.where("chunk_id < 'c3'"), retries=1) == {"c0": ("ONE", None), "c1": ("TWO", None), "c2": ("", "not yet")}
    assert asked() == ["bad", "bad", "one", "two"]
    (tmp_path / "mended").touch()
    assert ask(prompts, round_size=1) == {"c0": ("ONE", None), "c1": ("TWO", None), "c2": ("BAD", None), "c3": ("ONE", None), "c4": ("THREE", None)}
    assert asked() == ["bad", "bad", "bad", "one", "three", "two"] and ask(prompts.limit(0)) == {}


def test_store_and_exports_deal_no_wide_rows(spark, tmp_path, monkeypatch):
    from graphloom.plans import store

    monkeypatch.setattr(store, "TOLD", 1)
    schema = "document_id string, document_name string, source_path string, content string"
    docs = spark.createDataFrame([(f"d{i}", f"n{i}", f"/d{i}.md", "# A\n\nHBM3 has a bank and DDR4.") for i in range(4)], schema)
    g, path = build(docs), str(tmp_path / "store")
    nodes, links = g.valid("nodes"), g.valid("edges")
    fewer = store.written(store.entity_table(nodes.where("name <> 'HBM3' OR document_id <> 'd1'")), "fewer")
    for rows in (store.entity_table(nodes), store.relation_table(links, store.entity_table(nodes))):
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    gone = links.join(nodes.where("name = 'HBM3' AND document_id = 'd1'").select("document_id", F.col("id").alias("x")), "document_id").where("src = x OR tgt = x").count()
    assert gone and store.relation_table(links, fewer).count() == links.count() - gone
    twice = store.entity_table(nodes.unionByName(nodes.withColumns({"name": F.lit("later"), "seq": F.array(F.lit(9))}).where("document_id = 'd2'")))
    assert twice.count() == nodes.count() and {r.document_id for r in twice.where("name = 'later'").collect()} == {"d2"}
    persist(g, path)
    some = docs.where("document_id < 'd3'").withColumn("content", F.lit("# B"))
    persist(build(some), path)
    live = stored(spark, path, "entity")
    assert "SortMergeJoin" not in live._jdf.queryExecution().executedPlan().toString()
    assert {r.document_id for r in live.where("name = 'HBM3'").collect()} == {"d3"} and live.where("name = '# B'").count() == 3
    export_json(g, str(tmp_path / "lines"))
    assert all(n.endswith(".gz") for n in os.listdir(tmp_path / "lines") if n.startswith("part-"))


def test_rounds_stay_few_for_many_prompts():
    for n in (0, 1, 7, 32, 33, 1000, 8000, 100_000):
        found = list(llm._rounds(n))
        assert [k for first, end in found for k in range(first, end)] == list(range(n)) and len(found) <= 32 + n.bit_length()
    assert list(llm._rounds(20)) == [(k, k + 1) for k in range(20)]


def test_a_folder_of_many_files_is_read_by_few_tasks(spark, tmp_path):
    for n in range(300):
        at = tmp_path / "in" / f"{n % 3}" / "deep" / f"a+b %20 {n}.md"
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(f"# é {n}\r\n", encoding="utf-8", newline="")
    (tmp_path / "in" / "top.md").write_bytes(b"")
    for hidden in ("in/.x.md", "in/_x/y.md", "in/0/_z.md", "in/0/.h/y.md", "in/0/n.txt"):
        (tmp_path / hidden).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / hidden).write_text("hidden")
    found = read_markdown_folder(spark, str(tmp_path / "in"))
    assert found.rdd.getNumPartitions() <= 4
    rows = {r.source_path: r for r in found.collect()}
    at = str(tmp_path / "in" / "1" / "deep" / "a+b %20 4.md")
    assert len(rows) == 301 and rows[at].content == "# é 4\r\n" and rows[at].document_name == "a+b %20 4"
    assert rows[str(tmp_path / "in" / "top.md")].content == ""


def test_zipped_files_are_written_and_read_in_tasks(spark, tmp_path):
    from graphloom.scratch import put_texts, texts_at

    at = str(tmp_path / "kg" / "d" / "graph.json.gz")
    rows = spark.createDataFrame([(at, "é" * 9000)], "path string, text string")
    assert put_texts(rows) == 1 and (tmp_path / "kg" / "d" / "graph.json.gz").stat().st_size < 500
    assert texts_at(rows.select("path")).first().content == "é" * 9000
    assert spark.read.text(at).first().value == "é" * 9000
