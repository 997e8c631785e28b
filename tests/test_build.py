"""Parsing, trees, chunks, extraction and the whole build."""

import re

import pytest
from pyspark.sql import functions as F

from graphloom.functions import compact_text, merge_lines, normalize_key, slugify, stable_id
from graphloom.operators.blocks import components, resolve_path, title_level
from graphloom.operators.chunks import chunks
from graphloom.operators.normalize import cluster_nodes, merge_edges
from graphloom.operators.structural import structural_edges, structural_nodes
from graphloom.operators.heuristic import mentions
from graphloom.operators.running import running
from graphloom.operators.tree import sibling_keys, tree_nodes
from graphloom.operators.validate import graph_stats, judge_edges, judge_nodes
from graphloom.plans.build import build
from graphloom.scratch import written

DOCUMENT = "document_id string, document_name string, source_path string, content string"
GOLDEN = """# LPDDR5X Note

LPDDR5X at 8533 MT/s with tRCD 18 ns on a 12 nm process. The die has a channel.

## Stack

HBM3 has ECC. HBM3 gives 819 GB/s.
"""


def docs(spark, *texts):
    return spark.createDataFrame([(f"doc-{i}", f"d{i}", f"/data/d{i}.md", t) for i, t in enumerate(texts)], DOCUMENT)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "want"),
    [("## Hello  World!", "Hello-World"), ("a/b\\c", "a-b-c"), ("__x__", "x"), ("", "node"), ("   ", "node"), ("!!!", "node"), ("内存 芯片", "内存-芯片"), ("v1.2_b", "v1.2_b")],
)
def test_slugify(spark, text, want):
    assert value(spark, slugify(F.lit(text), "node")) == want


def test_text_functions(spark):
    assert value(spark, stable_id(F.lit("a"), F.lit("b"), prefix="p-")) == "p-fcd127ffa1016069"
    assert value(spark, stable_id(F.lit("a"), F.lit(None).cast("string"))) != value(spark, stable_id(F.lit("a")))
    assert value(spark, compact_text(F.lit("\n a\n\n\n\nb \x1f"))) == "a\n\nb"
    assert value(spark, normalize_key(F.lit(" Memory_Product:X-1!  y "))) == "memory productx 1 y"
    assert value(spark, merge_lines(F.array(F.lit("a\n b\n"), F.lit("b\nc"), F.lit(None)))) == "a\nb\nc"


@pytest.mark.parametrize(("title", "level"), [("# A", 1), ("### A", 3), ("1.2.3 A", 3), ("## 1 A", 2), ("8533 MT/s is fast", 1), ("第三章 A", 1), ("第三节 A", 2), ("1.1.1.1.1.1.1 A", 6), ("A", 1), ("", 1)])
def test_title_levels(spark, title, level):
    assert value(spark, title_level(F.lit(title))) == level


@pytest.mark.parametrize(("path", "want"), [("a/b.png", "/data/a/b.png"), ("../x.png", "/x.png"), ("/abs.png", "/abs.png"), ("https://h/i.png", "https://h/i.png"), ("", "")])
def test_image_paths(spark, path, want):
    assert value(spark, resolve_path(F.lit(path), F.lit("/data/d.md"))) == want


def test_components_in_order(spark):
    text = "# Root\n\nintro\n\n![x](i/a.png)\nsome note\nFigure 1: Shape\nrest of it\n\n## Part\ntext before\n\nTable 1. Values\n<table>\n<tr></tr>\n# inside\n</table>\nafter"
    rows = components(docs(spark, text)).orderBy("idx").collect()
    assert [r.type for r in rows] == ["section", "text", "image", "section", "text", "table", "text"]
    image, table = rows[2], rows[5]
    assert image.metadata.image_caption == ["Figure 1: Shape", "rest of it"] and image.metadata.note_text == "some note" and image.metadata.img_path == "/data/i/a.png"
    assert image.content == "Figure 1: Shape\nrest of it\n\n[Notes]\nsome note"
    assert table.metadata.table_caption == ["Table 1. Values"] and table.metadata.table_body == "<table>\n<tr></tr>\n# inside\n</table>"
    assert rows[4].content == "text before" and rows[6].content == "after" and rows[6].title == "## Part"


def test_image_without_caption_leaves_the_text(spark):
    rows = components(docs(spark, "one\n\ntwo\n\n![x](a.png)\n\nthree\n\nfour")).orderBy("idx").collect()
    assert [(r.type, r.content) for r in rows] == [("text", "one\n\ntwo"), ("image", ""), ("text", "three\n\nfour")]


def test_odd_documents(spark):
    open_table = "<table>\nx\n# no title\nto the end"
    rows = components(docs(spark, "", "\n \n", open_table, "a\r\n\r\nb c", "</table>\n# T", None)).orderBy("document_id", "idx").collect()
    found = {}
    for r in rows:
        found.setdefault(r.document_id, []).append((r.type, r.content))
    assert found == {"doc-2": [("table", f"[Table Body]\n{open_table}")], "doc-3": [("text", "a\n\nb\nc")], "doc-4": [("text", "</table>"), ("section", "")]}


def test_tree_levels_and_keys(spark):
    text = "# A\n### B\n## C\ntext\n# A\n# x\n# x\n# x_1\n## x\nmore"
    documents = docs(spark, text)
    rows = tree_nodes(documents, components(documents)).orderBy("idx").collect()
    assert [r.path for r in rows] == ["root", "root/A", "root/A/B", "root/A/C", "root/A/C/text", "root/A_1", "root/x", "root/x_1", "root/x_1_1", "root/x_1_1/x", "root/x_1_1/x/text"]
    by_id = {r.node_id: r for r in rows}
    assert all(by_id[r.parent_id].path == r.path.rsplit("/", 1)[0] for r in rows if r.parent_id)


def test_chunks(spark):
    documents = docs(spark, "# S\none\n\ntwo\n\n![x](a.png)\n\n## T\nthree\n\nfour")
    tree = tree_nodes(documents, components(documents))
    assert [r.content for r in chunks(tree, split_paragraphs=True).orderBy("idx", "piece_idx").collect()] == ["one", "two", "", "three", "four"]
    long = docs(spark, "x" * 2500)
    pieces = chunks(tree_nodes(long, components(long)), split_text=True).orderBy("piece_idx").collect()
    assert [len(r.content) for r in pieces] == [1200, 1200, 340] and len({r.chunk_id for r in pieces}) == 3


def test_build_counts_and_order(spark):
    g = build(docs(spark, GOLDEN, ""))
    stats = {r.document_id: r for r in g.stats.collect()}
    assert stats["doc-1"].node_count == 1 and stats["doc-1"].edge_count == 0
    names = [r.name for r in g.nodes.where("kind = 'semantic'").orderBy("seq").collect()]
    assert names == ["LPDDR5X", "tRCD", "12 nm process", "8533 MT/s", "18 ns", "die", "channel", "HBM3", "ECC", "819 GB", "819 GB/s"]
    n_pairs = 7 * 6 // 2 + 4 * 3 // 2
    assert stats["doc-0"].node_count == 5 + 11 and stats["doc-0"].edge_count == 9 + 11 + n_pairs
    assert g.valid("edges").where("relation_type = 'has_timing'").count() == 6
    assert g.review("nodes").count() == 0


NODE = "document_id string, seq array<int>, id string, name string, entity_type string, description string, kind string, evidence_span string, evidence_status string, ontology_status string, tree_path string, source_path string, source_trace_id string, modality string"


def nodes(spark, rows):
    from graphloom.operators.metadata import meta

    made = [("d", [i], r[0], r[1], r[2], r[3], r[4], r[5], "grounded" if r[5] else "missing", "unknown", "p", "s", "", r[6] if len(r) > 6 else "text") for i, r in enumerate(rows)]
    return spark.createDataFrame(made, NODE).withColumn("metadata", meta())


def edges(spark, rows):
    from graphloom.operators.metadata import meta

    schema = "document_id string, seq array<int>, id string, src string, tgt string, relation_type string, description string, edge_source string, evidence_span string, evidence_status string, ontology_status string, confidence double, tree_path string, source_path string"
    made = [("d", [i], f"e{i}", r[0], r[1], r[2], r[3], "extracted", r[4], "grounded", "unknown", r[5], "p", "s") for i, r in enumerate(rows)]
    return spark.createDataFrame(made, schema).withColumn("metadata", meta())


def test_merging(spark):
    rows = nodes(spark, [("a", "HBM3 ", "component", "one\n\nline", "semantic", "e1"), ("b", "die", "component", "x\n\n y", "semantic", "e2"), ("c", "hbm3", "component", "two\none", "semantic", "e1"), ("t", "T", "component", "z", "structural", "")])
    merged = {r.name: r for r in cluster_nodes(rows).collect()}
    assert merged["HBM3"].description == "one\nline\ntwo" and merged["HBM3"].metadata.mentions == ["HBM3", "hbm3"] and merged["HBM3"].evidence_span == "e1"
    assert merged["die"].description == "x\n\n y" and merged["T"].metadata.mentions == []
    links = edges(spark, [("a", "b", "part_of", "d1", "e", 0.6), ("c", "b", "part_of", "d2", "e", 0.9), ("a", "c", "part_of", "loop", "e", 0.9), ("q", "b", "affects", "d", "e", 0.5)])
    out = sorted(merge_edges(links, rows).collect(), key=lambda r: r.seq)
    assert [(r.description, r.confidence) for r in out] == [("d1\nd2", 0.9), ("d", 0.5)] and out[1].src == "q"


def test_validation_reasons(spark):
    rows = nodes(spark, [("ok", "A", "component", "", "semantic", "e"), ("bad", "B", "starship", "", "semantic", " "), ("img", "C", "IMAGE", "", "semantic", "", "image")])
    judged = judge_nodes(rows)
    reasons = {r.id: r.review_reasons for r in judged.collect()}
    assert reasons == {"ok": [], "bad": ["unknown_entity_type", "missing_evidence"], "img": ["missing_evidence"]}
    links = edges(spark, [("ok", "ok", "part_of", "", "e", 0.5), ("ok", "bad", "flies", "", "", 0.49), ("ok", "ok", "part_of", "", "e", float("nan"))])
    judged_edges = judge_edges(links, judged)
    assert [r.review_reasons for r in judged_edges.orderBy("seq").collect()] == [[], ["missing_valid_endpoint", "unknown_relation_type", "low_confidence", "missing_evidence"], []]
    documents = spark.createDataFrame([("d", "n", "s", "")], DOCUMENT)
    assert tuple(graph_stats(documents, judged, judged_edges).first())[1:] == (1, 2, 2, 1)


def test_structural_graph(spark):
    documents = docs(spark, "# A\none\n# B\ntwo")
    tree = tree_nodes(documents, components(documents))
    assert structural_nodes(tree).count() == 5
    kinds = structural_edges(tree).groupBy("relation_type").count().collect()
    assert {r.relation_type: r["count"] for r in kinds} == {"parent_of": 4, "contains": 4, "next_sibling": 1}


def plain_keys(slugs):
    used, keys = set(), []
    for slug in slugs:
        key, n = slug, 0
        while key in used:
            n += 1
            key = f"{slug}_{n}"
        used.add(key)
        keys.append(key)
    return keys


def test_sibling_keys_like_one_by_one(spark):
    import random

    random.seed(4)
    kinds = ["a", "a_1", "a_2", "a_3", "a_1_1", "a_1_2", "a_2_1", "a_1_1_1", "b", "b_01", "b_0", "b_1", "_1", "c_99999999999999999999"]
    lists = [["a", "a_1", "a", "a"], ["a_1", "a", "a", "a"], ["a", "a", "a_1", "a_1", "a_1_1"], ["a_1_1", "a_1", "a", "a", "a_1"], []]
    lists += [[random.choice(kinds) for _ in range(random.randint(1, 30))] for _ in range(150)] + [["x"] * 20_000 + ["x_3", "y"] + ["x"] * 50]
    rows = [(f"d{i % 7}", f"p{i}", 10_000 * i + j if i < len(lists) - 1 else 10**7 + j, s) for i, slugs in enumerate(lists) for j, s in enumerate(slugs)]
    frame = written(spark.createDataFrame(rows, "document_id string, parent_id string, idx int, slug string"), "slugs")
    got = {}
    for r in sibling_keys(frame).orderBy("idx").collect():
        got.setdefault(int(r.parent_id[1:]), []).append(r.key)
    assert got == {i: plain_keys(s) for i, s in enumerate(lists[:-1]) if s} | {len(lists) - 1: [*(["x"] + [f"x_{k}" for k in range(1, 20_000)]), "x_3_1", "y", *(f"x_{k}" for k in range(20_000, 20_050))]}


def test_long_documents_are_dealt(spark):
    import random

    random.seed(11)
    kinds = ["# A", "## A", "### b", "1.2 c", "###### d", "text", "more text", "", "", "<table>", "<tr>", "</table>", "<table>x</table>", "Table 1. Cap", "![x](a.png)", "note", "Figure 2: cap", "# A_1", "# A_2"]
    texts = ["\n".join(random.choices(kinds, k=random.randint(0, 90))) for _ in range(25)] + ["", "\n" * 40, "# A\n" * 30, "text\n" * 30, "<table>\n" + "# A\n" * 20, None]
    texts += ["# A\n![x](a.png)\n" + "note\n" * 9 + "Figure 1: late\n" + "cap\n" * 9, "text\n\nTable 1. Cap\n\n" + "\n" * 9 + "<table>\n</table>", "Table 1. Cap\n# T\n<table></table>\n<table></table>"]
    documents = docs(spark, *texts)
    whole = components(documents)
    assert whole.where("dealt IS NOT NULL").count() == 0
    want_parts, want_tree = sorted(map(str, whole.drop("dealt").collect())), sorted(map(str, tree_nodes(documents, whole).collect()))
    for long_text, block in ((0, 1), (100, 4), (30, 1000)):
        parts = components(documents, long_text=long_text, block=block)
        assert {r.dealt for r in parts.collect()} >= {block}
        assert sorted(map(str, parts.drop("dealt").collect())) == want_parts
        assert sorted(map(str, tree_nodes(documents, parts).collect())) == want_tree


def test_windows_of_dealt_rows_stay_inside_blocks(spark):
    rows = spark.range(100).selectExpr("'d' AS document_id", "CAST(id AS int) AS n", "16 AS dealt", "repeat('x', 9) AS payload")
    found = running(rows, "n", True, last={"a": F.when(F.col("n") % 30 == 7, F.col("n"))}, total={"b": F.col("n")}, following={"c": F.when(F.col("n") % 3 == 0, F.col("n"))})
    windows = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in x]
    assert windows and all(re.search(r"\[document_id#\d+, block#\d+L?\], \[n#|\[document_id#\d+\], \[block#", x) for x in windows)
    got = [(r.n, r.a, r.b, r.c) for r in found.orderBy("n").collect()]
    want = [(n, (n - 8) // 30 * 30 + 7 if n > 7 else None, n * (n + 1) // 2, n + 1 if (n + 1) % 3 == 0 and n < 99 else None) for n in range(100)]
    assert got == want


def test_a_document_is_parsed_once_and_without_python(spark, tmp_path):
    docs(spark, *[GOLDEN, "# x\n# x_1\n# x\ntext of the die"] * 3).write.parquet(str(tmp_path / "docs"))
    documents = spark.read.parquet(str(tmp_path / "docs"))
    tree = tree_nodes(documents, components(documents))
    for rows in (tree, mentions(chunks(tree))):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
        assert plan.count(str(tmp_path)) <= 1  # the root rows; lines come from what was written


def test_only_the_owner_removes_tables(spark):
    import threading

    from graphloom.scratch import owned

    kept = []

    def other():
        with owned() as mine:
            kept.append((written(spark.range(5), "other"), mine))

    with owned() as tables:
        first = written(spark.range(3), "first")
        with owned() as inner:
            second = written(spark.range(4), "second")
            third = written(spark.range(6), "third")
        thread = threading.Thread(target=other)
        thread.start()
        thread.join()
    inner.clear(spark, but="third")
    assert third.count() == 6 and first.count() == 3 and kept[0][0].count() == 5
    for frame, owner in ((second, None), (first, tables), (third, None)):
        if owner:
            owner.clear(spark)
        with pytest.raises(Exception, match="(?i)exist"):
            frame.count()
    assert kept[0][0].count() == 5


def test_edges_are_dealt_once_and_heavy_documents_by_joins(spark):
    from graphloom.operators import ends
    from graphloom.plans.build import candidates

    documents = docs(spark, *[GOLDEN, "# x\nthe die, a bank and copper\n# x_1\n# x\nDDR4 and ddr4 of the die"] * 3, "")
    tree = written(tree_nodes(documents, components(documents)), "tree")
    found = written(mentions(chunks(tree)), "mentions")
    ((nodes, links, parts),) = candidates(tree, found)
    merged = merge_edges(links, nodes, together=True)
    judged = judge_edges(merged, written(judge_nodes(cluster_nodes(nodes)), "judged").repartition(parts, "document_id"), together=True)
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") > 0  # tables as they were written, not edges
    plain = judge_edges(merge_edges(links, nodes), judge_nodes(cluster_nodes(nodes)))
    want = sorted(map(str, plain.select(*judged.columns).collect()))
    assert sorted(map(str, judged.collect())) == want and want
    # The golden documents are heavy, the others are not.
    (light, n), (heavy, none) = ends.dealt([tree, found], heavy=13, task_rows=10)
    assert n >= 5 and none is None and {r.document_id for r in heavy[0].select("document_id").distinct().collect()} == {"doc-0", "doc-2", "doc-4"}
    assert light[0].count() + heavy[0].count() == tree.count() and light[1].count() + heavy[1].count() == found.count()


def test_parsing_is_dealt_before_lines_are_split(spark, tmp_path):
    from graphloom import queries

    docs(spark, *[GOLDEN] * 5).write.parquet(str(tmp_path / "docs"))
    plan = components(spark.read.parquet(str(tmp_path / "docs")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") == 1
    for rows in (queries.corpus(spark, "/root/testdata/sf0.001"), queries._llm(spark, "/root/testdata/sf0.001")[1]):
        assert rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))  # one file, one task before
