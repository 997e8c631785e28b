"""Component lists to document trees, as adjacency lists.

A section's parent is the nearest section before it with a smaller level, any other
component's parent the nearest section. Levels are 1 to 6, so six running values hold
all possible ancestors of every row, and its path is put together inside the row.
Components of a long document are dealt over tasks, as its lines are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.text import slugify
from graphloom.operators.metadata import meta
from graphloom.operators.running import running, spread
from graphloom.scratch import written, written_by

_LEVELS = range(1, 7)


def _open(sections: str, level: Column) -> Column:
    """Of the last sections of each level, nearest first, those that later ones have not closed."""
    nearest = F.sort_array(F.filter(sections, lambda s: s["level"] < level), asc=False)
    start = F.struct(F.lit(99).alias("level"), F.slice(nearest, 1, 0).alias("kept"))
    return F.aggregate(
        nearest, start,
        lambda acc, s: F.when(s["level"] < acc["level"], F.struct(s["level"].alias("level"), F.concat(acc["kept"], F.array(s)).alias("kept"))).otherwise(acc),
        lambda acc: acc["kept"],
    )


def _parents(rows: DataFrame, dealt: bool) -> DataFrame:
    """Adds ``open``: the ancestors of each row, nearest first; sections stand below smaller levels only."""
    bound = F.when(F.col("node_type") == "section", F.col("level")).otherwise(F.lit(99))
    here = F.struct("idx", "level", "node_id", "key")
    last = {f"section_{k}": F.when((F.col("node_type") == "section") & (F.col("level") == k), here) for k in _LEVELS}
    before = running(rows, "idx", dealt, last=last)
    return before.withColumn("sections", F.array_compact(F.array(*last))).withColumn("open", _open("sections", bound)).drop("sections", *last)


_PARENT = ["document_id", "parent_id"]


def _contended(slugged: DataFrame) -> DataFrame | None:
    """(document_id, idx, exact): keys of the children of parents where a slug looks like a numbered one; None without any.

    All children of a parent with the same slug are a group; its n-th child asks for the
    slug, then slug_1 and so on, and the first free one is its own. Key slug_k has one
    other claimant, the first child of the group of that slug, and who comes first gets
    it. So a group's keys follow from when its rivals come (a fold over them), and whether
    its own slug is taken follows from the group it is a rival of: those come first, one
    round for each length of such chains, until no group is left.
    """
    numbered = F.regexp_extract("slug", r"\A(.+)_[1-9]\d{0,17}\z", 1)
    odd = slugged.where(numbered != "").select(*_PARENT).distinct()
    if odd.isEmpty():
        return None
    children = slugged.join(odd, _PARENT, "left_semi").select(*_PARENT, "slug", "idx")
    k = F.when(numbered != "", F.regexp_extract("slug", r"_(\d+)\z", 1).cast("long"))
    groups = children.groupBy(*_PARENT, "slug").agg(F.sort_array(F.collect_list("idx")).alias("at"))
    groups = written(groups.withColumns({"of": F.when(numbered != "", numbered), "k": k, "came": F.get("at", 0)}), "key-groups")
    rivals = groups.where("of IS NOT NULL").groupBy(*_PARENT, F.col("of").alias("slug")).agg(F.sort_array(F.collect_list(F.struct("k", "came"))).alias("rivals"))
    left = groups.join(rivals, [*_PARENT, "slug"], "left")
    above = groups.select(*_PARENT, F.col("slug").alias("of"))
    level = left.join(above, [*_PARENT, "of"], "left_anti").withColumn("first", F.lit(0).cast("long"))
    done = None
    while not level.isEmpty():
        level = written(level.select(*_PARENT, "slug", "at", "first", _numbers("at", "rivals", F.col("first")).alias("n")), "key-level")
        done = level if done is None else done.unionByName(level)
        taken = level.select(*_PARENT, F.col("slug").alias("of"), F.col("n.taken").alias("taken"))
        level = left.join(taken, [*_PARENT, "of"]).withColumn("first", F.array_contains("taken", F.col("k")).cast("long"))
    # The n-th child skips the numbers that rivals got and that would have been its own or those of children before it.
    passed = F.transform("n.lost", lambda x, i: x - i - F.col("first"))
    each = done.select("document_id", "slug", "first", passed.alias("passed"), F.posexplode("at").alias("nth", "idx"))
    number = F.col("first") + F.col("nth") + F.size(F.filter("passed", lambda x: x <= F.col("nth")))
    return each.select("document_id", "idx", F.when(number == 0, F.col("slug")).otherwise(F.concat("slug", F.lit("_"), number)).alias("exact"))


def _numbers(at: str, rivals: str, first: Column) -> Column:
    """(lost, taken): the numbers of a group that its rivals get, and those that it takes before they come, ascending.

    ``at`` has the places of its children, ``rivals`` (k, came) of the others, by k, and
    ``first`` is the number that its first child asks for.
    """
    none = F.array().cast("array<bigint>")

    def step(state: Column, rival: Column) -> Column:
        asks = F.get(at, (rival["k"] - F.size(state["lost"]) - first).cast("int"))  # null if no child comes that far
        add = lambda name, when: F.when(F.coalesce(when, F.lit(False)), F.concat(state[name], F.array(rival["k"]))).otherwise(state[name]).alias(name)
        return F.struct(add("lost", rival["came"] < asks), add("taken", rival["came"] > asks))

    empty = F.array().cast("array<struct<k:bigint,came:int>>")
    return F.aggregate(F.coalesce(rivals, empty), F.struct(none.alias("lost"), none.alias("taken")), step)


def sibling_keys(slugged: DataFrame, dealt: bool = False) -> DataFrame:
    """Adds ``key`` to stored rows with a slug, unique among siblings: the slug, then slug_1, slug_2 and so on in order."""
    nth = F.row_number().over(Window.partitionBy(*_PARENT, "slug").orderBy("idx"))
    exact = _contended(slugged)
    numbered = (slugged if dealt else spread(slugged, "document_id")).withColumn("nth", nth)
    simple = F.when(F.col("nth") == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("_"), F.col("nth") - 1))
    if exact is None:
        return numbered.withColumn("key", simple).drop("nth")
    return numbered.join(exact, ["document_id", "idx"], "left").withColumn("key", F.coalesce("exact", simple)).drop("exact", "nth")


def tree_nodes(documents: DataFrame, components: DataFrame) -> DataFrame:
    """(document_id, source_path, idx, node_id, parent_id, title, level, content, node_type, path, metadata).

    Each document has a root with idx 0; children follow in document order, which is
    the order of a depth-first walk. Documents are parsed once: rows with their parents
    are written to the shared folder, and keys and paths come from there.
    """
    rows = components.select(
        "document_id", "source_path", "dealt", "idx", F.col("component_id").alias("node_id"), "title", F.greatest(F.lit(1), "title_level").alias("level"),
        "content", F.col("type").alias("node_type"), "metadata", F.lit(None).cast("string").alias("key"),
    )
    columns = ["document_id", "source_path", "idx", "node_id", "parent_id", "title", "level", "content", "node_type", "path", "metadata"]
    root = documents.select(
        "document_id", "source_path", F.lit(0).alias("idx"), F.lit("root").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.col("document_name").alias("title"),
        F.lit(0).alias("level"), F.lit("").alias("content"), F.lit("root").alias("node_type"), F.lit("root").alias("path"),
        meta(document_id=F.col("document_id"), source_path=F.col("source_path")).alias("metadata"),
    )
    tree = root.unionByName(_with_paths(rows.where("dealt IS NULL"), False).select(*columns))
    long = rows.where("dealt IS NOT NULL")  # folds to nothing where no document is long
    return tree if long.isEmpty() else tree.unionByName(_with_paths(long, True).select(*columns))


def _with_paths(rows: DataFrame, dealt: bool) -> DataFrame:
    seed = F.when(F.col("node_type") == "section", F.col("title")).otherwise(F.col("node_type"))
    placed = _parents(rows, dealt).withColumns({"parent_id": F.coalesce(F.get("open", 0)["node_id"], F.lit("root")), "slug": slugify(seed, "node")}).drop("open", "key")
    # Rows of ordinary documents stand together by document; stored like that, they are not dealt again.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stored = written(placed, "placed") if dealt else written_by(placed, "placed", "document_id", parts)
    keyed = _parents(sibling_keys(stored, True).drop("slug"), dealt)
    return keyed.withColumn("path", F.concat_ws("/", F.lit("root"), F.reverse(F.transform("open", lambda s: s["key"])), "key"))
