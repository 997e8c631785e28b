"""Markdown files, manifests and tables of texts as documents.

A document is (document_id, document_name, source_path, content).
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import stable_id
from graphloom.scratch import files_below, texts_at

COLUMNS = ["document_id", "document_name", "source_path", "content"]


def _with_id(rows: DataFrame) -> DataFrame:
    return rows.withColumn("document_id", stable_id("document_name", "source_path", prefix="doc-")).select(*COLUMNS)


def _checked(path: str) -> str:
    at = Path(path).expanduser().resolve()
    if at.suffix.lower() != ".md":
        raise ValueError(f"not a Markdown file: {at}")
    if not at.is_file():
        raise FileNotFoundError(at)
    return str(at)


def plain_path(url: Column) -> Column:
    """A local file's path without scheme and escapes; other files' URLs as they are."""
    local = F.url_decode(F.replace(F.regexp_replace(url, r"\Afile:(//)?", ""), F.lit("+"), F.lit("%2B")))
    return F.when(url.startswith("file:"), local).otherwise(url)


def whole_texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source_path, content) of whole files."""
    rows = spark.read.text(paths, wholetext=True)
    return rows.select(plain_path(F.col("_metadata.file_path")).alias("source_path"), F.col("value").alias("content"))


def from_files(rows: DataFrame) -> DataFrame:
    """Documents of whole Markdown files, from a batch or a stream; stems are names."""
    at = plain_path(F.col("_metadata.file_path"))
    return _with_id(rows.select(F.regexp_extract(at, r"([^/]*)\.md\z", 1).alias("document_name"), at.alias("source_path"), F.col("value").alias("content")))


def read_markdown(spark: SparkSession, path: str, document_name: str | None = None) -> DataFrame:
    """One local Markdown file; the name is the file's stem unless given."""
    at = _checked(path)
    rows = whole_texts(spark, [at]).select(F.lit(document_name or Path(at).stem).alias("document_name"), F.lit(at).alias("source_path"), "content")
    return _with_id(rows)


def read_markdown_folder(spark: SparkSession, path: str) -> DataFrame:
    """All Markdown files below a path; their stems are their names. Tasks list folders and read files, however many there are."""
    rows = texts_at(files_below(spark, path, ".md"))
    return _with_id(rows.select(F.regexp_extract("path", r"([^/]*)\.md\z", 1).alias("document_name"), F.col("path").alias("source_path"), "content"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of names and Markdown paths, which stand against the working folder."""
    at = Path(path).expanduser().resolve()
    if at.suffix.lower() != ".json":
        raise ValueError(f"not a JSON manifest: {at}")
    if not at.is_file():
        raise FileNotFoundError(at)
    entries = json.loads(at.read_text(encoding="utf-8"))
    if not isinstance(entries, dict):
        raise ValueError("a manifest must be an object of names and paths")
    for name, target in entries.items():
        if not name.strip() or not isinstance(target, str) or not target.strip():
            raise ValueError(f"a manifest's names and paths must be non-empty strings: {name!r}")
    if not entries:
        return spark.createDataFrame([], "document_id string, document_name string, source_path string, content string")
    named = spark.createDataFrame([(name, _checked(target)) for name, target in entries.items()], "document_name string, path string")
    return _with_id(texts_at(named).withColumnRenamed("path", "source_path"))


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """A Markdown file or a manifest, by its suffix."""
    suffix = Path(path).suffix.lower()
    if suffix == ".md":
        return read_markdown(spark, path)
    if suffix == ".json":
        return read_manifest(spark, path)
    raise ValueError(f"input must be a .md file or a .json manifest: {path}")


def from_table(rows: DataFrame, name: Column, content: Column, folder: str) -> DataFrame:
    """Documents of a table; their source path is ``folder/name``."""
    named = rows.select(name.cast("string").alias("document_name"), content.alias("content"))
    return _with_id(named.withColumn("source_path", F.concat(F.lit(f"{folder}/"), "document_name")))
