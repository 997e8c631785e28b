"""Tree nodes to chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import stable_id, strip

SIZE, OVERLAP = 1200, 120


def paragraphs(text: Column) -> Column:
    """The stripped paragraphs of a text; the text itself if it has none but is not empty."""
    found = F.filter(F.transform(F.split(text, "\n\n", -1), strip), lambda p: p != "")
    return F.when(F.size(found) > 0, found).when(text != "", F.array(text)).otherwise(F.array().cast("array<string>"))


def windows(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Overlapping windows of a text, stripped, empty ones left out; a text that fits stays as it is."""
    step = max(size - overlap, 1)
    n = F.length(text)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda s: (s == 0) | (s - step + size < n))
    cut = F.filter(F.transform(starts, lambda s: strip(F.substring(text, s + 1, F.lit(size)))), lambda x: x != "")
    return F.when(n <= size, F.array(text)).otherwise(cut)


def chunks(nodes: DataFrame, split_text: bool = False, split_paragraphs: bool = False, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(document_id, source_path, idx, piece_idx, chunk_id, node_id, parent_id, node_type, tree_path, level, content, metadata).

    Roots, sections and empty texts have no chunk; empty images and tables have one.
    Only texts are split, first into paragraphs, then into windows.
    """
    is_text = F.col("node_type") == "text"
    kept = nodes.where(~F.col("node_type").isin("root", "section") & ~(is_text & (F.col("content") == "")))
    pieces = F.array("content")
    if split_paragraphs:
        pieces = F.when(is_text, paragraphs(F.col("content"))).otherwise(pieces)
    if split_text:
        pieces = F.when(is_text, F.flatten(F.transform(pieces, lambda p: windows(p, size, overlap)))).otherwise(pieces)
    rows = kept.select("*", F.posexplode(pieces).alias("nth", "piece")).withColumn("piece_idx", F.col("nth") + 1)
    return rows.select(
        "document_id", "source_path", "idx", "piece_idx", stable_id("node_id", "path", "piece_idx", prefix="chk-").alias("chunk_id"), "node_id", "parent_id",
        "node_type", F.col("path").alias("tree_path"), "level", F.col("piece").alias("content"), "metadata",
    )
