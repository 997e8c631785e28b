"""Markdown documents to components: sections, texts, tables and images in order.

A document's lines get their table state, boundaries and segments from running values
over (document_id, line_no); each segment is then put together inside one row. All steps
of ordinary documents share the partitioning by document_id, so there is a single
shuffle; long documents are dealt over tasks by blocks of lines (``running``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.text import SPACE, compact_text, stable_id, strip
from graphloom.operators.metadata import meta
from graphloom.operators.running import BLOCK, LONG_TEXT, by_length, running, spread

_NUMBERS = r"[一二三四五六七八九十百千万\d]+"
#: Line patterns; fixed values.
TITLE = rf"(?U)\A(?:#{{1,6}}{SPACE}+.+|\d+(?:\.\d+)+(?:{SPACE}+.*)?\z|\d+{SPACE}+.+\z|第{_NUMBERS}[章节篇节]{SPACE}*.+)"
TABLE_CAPTION = rf"(?iU)\A(table|tab\.?){SPACE}*\d+[.:]?{SPACE}+"
IMAGE_CAPTION = rf"(?iU)\A(?:(?:figure|fig\.?|image|img\.?){SPACE}*\d+[.:]?{SPACE}+|图{SPACE}*\d+[.:：]?)"
MARKDOWN_IMAGE = r"\A!\[[^\]]*\]\([^)]+\)"
HTML_IMAGE = r"(?i)<img\b[^>]*src=['\"][^'\"]+['\"][^>]*>"
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1c-\x1e\x85\u2028\u2029]"


def lines_of(documents: DataFrame) -> DataFrame:
    """(document_id, source_path, line_no, raw, line): lines as read and stripped; no empty line after a last break."""
    # A column of its own, since a generator makes an expression anew wherever it stands.
    split = documents.withColumn("parts", F.split(F.coalesce("content", F.lit("")), LINE_BREAK, -1))
    parts = F.when(F.element_at("parts", -1) == "", F.slice("parts", 1, F.size("parts") - 1)).otherwise(F.col("parts"))
    dealt = [c for c in documents.columns if c == "dealt"]
    rows = split.select("document_id", "source_path", *dealt, F.posexplode(parts).alias("line_no", "raw"))
    return rows.withColumn("line", strip("raw"))


def is_title(line: Column) -> Column:
    return line.rlike(TITLE)


def is_image(line: Column) -> Column:
    return line.rlike(MARKDOWN_IMAGE) | line.rlike(HTML_IMAGE)


def title_level(title: Column | str) -> Column:
    """1 to 6: the larger of the heading marks and the depth that a numbering tells."""
    text = strip(title)
    marks = F.length(F.regexp_extract(text, rf"(?U)\A(#{{1,6}}){SPACE}+.+\z", 1))
    rest = F.when(marks > 0, strip(F.regexp_replace(text, rf"(?U)\A#{{1,6}}{SPACE}+", ""))).otherwise(text)
    numeric = F.regexp_extract(rest, rf"(?U)\A(\d+(?:\.\d+)*)(?:{SPACE}+.+)?\z", 1)
    depth = F.least(F.lit(6), F.length(F.regexp_replace(numeric, r"[^.]", "")) + 1)
    chapter = F.regexp_extract(rest, rf"(?U)\A第{_NUMBERS}([章节篇])", 1)
    level = (
        F.when(numeric != "", F.greatest(marks, depth))
        .when(chapter != "", F.greatest(marks, F.when(chapter == "节", 2).otherwise(1)))
        .when(marks > 0, marks)
        .otherwise(1)
    )
    return level.cast("int")


def classified(lines: DataFrame, dealt: bool = False) -> DataFrame:
    """Adds each line's role: its segment, the segment's kind, and what the line is in there.

    ``part`` is head (a boundary line), table, caption, note or text. Inside a table
    nothing is a boundary; a table runs from its opening line through the first line
    with the closing tag. An image followed by a caption takes all lines up to the next
    boundary.
    """
    lower = F.lower("line")
    opens, closes = lower.startswith("<table"), lower.contains("</table>")
    state = F.when(closes, "out").when(opens, "in")
    inside = running(lines, "line_no", dealt, last={"state": state})
    head = F.when(is_title(F.col("line")), "title").when(opens, "table").when(is_image(F.col("line")), "image")
    marked = inside.withColumn("inside", F.coalesce(F.col("state") == "in", F.lit(False))).drop("state").withColumn("head", F.when(~F.col("inside"), head))
    segments = running(marked, "line_no", dealt, total={"segment": F.col("head").isNotNull().cast("int")})
    whole = Window.partitionBy("document_id", "segment")
    caption = F.when(F.col("head").isNull() & F.col("line").rlike(IMAGE_CAPTION), F.col("line_no"))
    known = segments.withColumns({"kind": F.coalesce(F.max("head").over(whole), F.lit("text")), "caption_at": F.min(caption).over(whole)})
    image = (F.col("kind") == "image") & F.col("caption_at").isNotNull()
    part = (
        F.when(F.col("head").isNotNull(), "head")
        .when(F.col("inside"), "table")
        .when(image & (F.col("line_no") >= F.col("caption_at")), "caption")
        .when(image, "note")
        .otherwise("text")
    )
    return known.withColumn("part", part).drop("inside", "caption_at")


def _joined(part: str, column: str) -> Column:
    """The lines of one part of a segment, in order."""
    kept = F.filter("rows", lambda r: r["part"] == part)
    return F.transform(kept, lambda r: r[column])


def _segments(lines: DataFrame, dealt: bool) -> DataFrame:
    """One row for each segment, with its texts."""
    row = F.struct("line_no", "part", "raw", "line")
    grouped = classified(lines, dealt).groupBy("document_id", "source_path", "dealt", "segment", "kind").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    blank_out = lambda r: F.when(r["line"] == "", "").otherwise(r["raw"])
    text = F.transform(F.filter("rows", lambda r: r["part"] == "text"), blank_out)
    not_blank = lambda x: x != ""
    return grouped.select(
        "document_id", "source_path", "dealt", "segment", "kind",
        F.get(_joined("head", "line"), 0).alias("head"),
        F.array_join(text, "\n").alias("buffer"),
        compact_text(F.array_join(F.transform(F.filter("rows", lambda r: r["part"].isin("head", "table")), lambda r: r["raw"]), "\n")).alias("table_body"),
        F.filter(_joined("caption", "line"), not_blank).alias("captions"),
        compact_text(F.array_join(F.filter(_joined("note", "line"), not_blank), "\n")).alias("notes"),
    )


def resolve_path(path: Column, source_path: Column) -> Column:
    """URLs and absolute paths as they are, others against the document's folder, without ``.`` and ``..``."""
    folder = F.regexp_replace(source_path, r"[^/]*\z", "")
    parts = F.split(F.concat(folder, path), "/")
    empty = F.array().cast("array<string>")
    flat = F.aggregate(
        parts, empty,
        lambda acc, p: F.when((p == "") | (p == "."), acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))),
    )
    joined = F.concat(F.when(source_path.startswith("/"), "/").otherwise(""), F.array_join(flat, "/"))
    return F.when(path == "", "").when(path.rlike(r"\A[a-zA-Z][a-zA-Z0-9+.-]*://") | path.startswith("/"), path).otherwise(joined)


def image_path(line: Column) -> Column:
    """The target of a Markdown image, else the source of an HTML one."""
    found = F.regexp_extract(line, rf"(?U)\A!\[[^\]]*\]\(([^)\s\x1c-\x1f]+)(?:{SPACE}+\"[^\"]*\")?\)", 1)
    html = F.regexp_extract(line, r"(?i)<img\b[^>]*src=['\"]([^'\"]+)['\"][^>]*>", 1)
    return strip(F.when(found != "", found).otherwise(html))


def components(documents: DataFrame, long_text: int = LONG_TEXT, block: int = BLOCK) -> DataFrame:
    """(document_id, source_path, dealt, idx, component_id, type, title, content, title_level, metadata).

    A document without content has no component. The last paragraph before a table
    becomes the table's caption if it reads like one. Documents of more than ``long_text``
    characters are dealt over tasks in blocks of ``block`` lines; ``dealt`` holds that
    number, null for others, whose lines meet in one task. A component is always put
    together in one row.
    """
    return by_length(documents, _components, long_text, block)


def _components(documents: DataFrame, dealt: bool) -> DataFrame:
    # Ordinary documents are dealt before they are split: all that follows runs where they are.
    segments = _segments(lines_of(documents if dealt else spread(documents, "document_id")), dealt)
    trimmed = F.regexp_replace("buffer", r"\n+\z", "")
    paragraph = F.element_at(F.split(trimmed, r"\n{2,}", -1), -1)
    candidate = F.when(compact_text(paragraph).rlike(TABLE_CAPTION), compact_text(paragraph))
    title = F.when(F.col("kind") == "title", F.col("head"))
    segments = running(
        segments.withColumn("candidate", candidate), "segment", dealt,
        last={"before": F.struct("candidate"), "title_before": title}, following={"next_kind": F.col("kind")},
    )
    claimed = F.col("candidate").isNotNull() & F.coalesce(F.col("next_kind") == "table", F.lit(False))
    segments = segments.withColumns({
        "text": compact_text(F.when(claimed, trimmed.substr(F.lit(1), F.length(trimmed) - F.length(paragraph))).otherwise(F.col("buffer"))),
        "caption": F.when(F.col("kind") == "table", F.coalesce("before.candidate", F.lit(""))).otherwise(""),
        "title": F.coalesce(title, "title_before", F.lit("Document")),
    })

    none = F.array().cast("array<string>")
    table_caption = F.when(F.col("caption") != "", F.array("caption")).otherwise(none)
    table_text = F.concat(F.when(F.col("caption") != "", F.concat(F.lit("[Table Caption]\n"), "caption", F.lit("\n\n"))).otherwise(""), F.lit("[Table Body]\n"), "table_body")
    image_text = F.concat_ws(
        "\n\n",
        F.when(F.size("captions") > 0, compact_text(F.array_join("captions", "\n"))),
        F.when(F.col("notes") != "", F.concat(F.lit("[Notes]\n"), "notes")),
    )
    table_meta = meta(table_body=F.col("table_body"), table_caption=table_caption, image_caption=none, note_text=F.lit(""))
    image_meta = meta(img_path=resolve_path(image_path(F.col("head")), F.col("source_path")), image_caption=F.col("captions"), table_caption=none, note_text=F.col("notes"))
    item = lambda kind, content, about: F.struct(F.lit(kind).alias("type"), compact_text(content).alias("content"), about.alias("metadata"))
    head = F.when(F.col("kind") == "title", item("section", F.lit(""), meta())).when(F.col("kind") == "table", item("table", table_text, table_meta)).when(F.col("kind") == "image", item("image", image_text, image_meta))
    body = F.when(F.col("text") != "", item("text", F.col("text"), meta()))
    items = segments.select("document_id", "source_path", "dealt", "segment", "title", F.array_compact(F.array(head, body)).alias("items"))
    numbered = running(items, "segment", dealt, total={"through": F.size("items")})
    found = numbered.select("document_id", "source_path", "dealt", "title", (F.col("through") - F.size("items")).cast("int").alias("earlier"), F.posexplode("items").alias("nth", "item"))
    found = found.withColumn("idx", F.col("earlier") + F.col("nth") + 1)
    return found.select(
        "document_id", "source_path", "dealt", "idx", stable_id("document_id", "idx", "item.type", "title", prefix="cmp-").alias("component_id"),
        F.col("item.type").alias("type"), "title", F.col("item.content").alias("content"), title_level("title").alias("title_level"), F.col("item.metadata").alias("metadata"),
    )
