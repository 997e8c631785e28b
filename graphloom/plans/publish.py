"""Publishing exported graphs for a viewer: ``python -m graphloom.plans.publish WORKING_DIR PUBLIC_DIR``."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.store import write_index
from graphloom.scratch import absolute, exists, put_texts, texts_at
from graphloom.sources.documents import whole_texts
from graphloom.sources.graphs import discover_exports

_ABOUT = "document_id string, document_name string, source_path string"


def viewer_index(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(at, nth, document_id, document_name, source_path) of graph files, in their order.

    A file without an id takes the folder above its exports for one; without a name, its id.
    """
    places = spark.createDataFrame(list(enumerate(paths)), "nth int, at string")
    about = F.get_json_object("content", "$.document")
    odd = about.isNotNull() & ~about.startswith("{")
    said = F.from_json(F.when(odd, F.raise_error(F.concat(F.lit("no document in "), "source_path"))).otherwise(F.coalesce(about, F.lit("{}"))), _ABOUT)
    rows = whole_texts(spark, paths).select(F.col("source_path").alias("at"), said.alias("said")).join(F.broadcast(places), "at")
    document_id = F.coalesce(F.nullif("said.document_id", F.lit("")), F.regexp_extract("at", r"([^/]+)/[^/]+/[^/]+\z", 1))
    return rows.select(
        "at", "nth", document_id.alias("document_id"), F.coalesce(F.nullif("said.document_name", F.lit("")), document_id).alias("document_name"),
        F.coalesce("said.source_path", F.lit("")).alias("source_path"),
    )


def publish(spark: SparkSession, working_dir: str, public_dir: str, zipped: bool = False) -> dict:
    """Puts the graphs of a working folder below ``public_dir/kg`` and writes their index; files go from task to task.

    A build that wrote an index table says what there is; other folders are looked
    through, see ``discover_exports``. Of graphs with the same id the last is put, of those
    with the same name the last is listed. ``zipped`` puts graph.json.gz, for servers
    that send such files for graph.json, which the index lists.
    """
    root, kg = absolute(spark, working_dir), f"{absolute(spark, public_dir)}/kg"
    paths = None
    if exists(spark, f"{root}/index"):
        listed = spark.read.parquet(f"{root}/index")
        rows = listed.select(F.col("export_path").alias("at"), F.lit(0).alias("nth"), "document_id", "document_name", "source_path")
    else:
        paths = discover_exports(spark, working_dir)
        if not paths:
            raise FileNotFoundError(f"no graph exports under {working_dir}")
        rows = viewer_index(spark, paths)
    rows = rows.withColumn("graph_path", F.concat("document_id", F.lit("/graph.json")))
    last = rows.groupBy("document_id").agg(F.max_by(F.struct("at", "nth", "document_name", "source_path", "graph_path"), F.struct("nth", "at")).alias("row")).select("document_id", "row.at", "row.graph_path")
    # A task reads the files of its own rows: texts that met rows in a join would be taken for as small as their paths, and broadcast.
    texts = texts_at(last.select(F.col("at").alias("path"), "graph_path")) if paths is None else last.join(whole_texts(spark, paths).withColumnRenamed("source_path", "at"), "at")
    put_texts(texts.select(F.concat(F.lit(f"{kg}/"), "graph_path", F.lit(".gz" if zipped else "")).alias("path"), F.col("content").alias("text")))
    index = f"{kg}/index.json"
    listed = rows.groupBy("document_name").agg(F.max_by(F.struct("document_id", "source_path", "graph_path"), F.struct("nth", "at")).alias("row"))
    listed = listed.select("document_name", "row.*")
    write_index(listed, index)
    return {"graph_count": listed.count(), "index_path": index}


if __name__ == "__main__":
    print(publish(SparkSession.builder.appName("graphloom-publish").getOrCreate(), *sys.argv[1:3]))
