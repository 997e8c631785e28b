"""Command line: ``python -m graphloom.plans.run --config FILE`` or ``--input FILE``."""

from __future__ import annotations

import argparse
import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import llm
from graphloom.operators.blocks import components
from graphloom.operators.chunks import chunks
from graphloom.operators.tree import tree_nodes
from graphloom.plans.build import Graph, build, finish
from graphloom.plans.store import export_files, persist
from graphloom.plans.schema import Ontology
from graphloom.scratch import owned, written
from graphloom.sources.config import BuildConfig, load_config
from graphloom.sources.documents import load_documents


def build_with_model(
    documents: DataFrame, make_client: Callable[[], llm.Client], store: str, split_text: bool = False, split_paragraphs: bool = False, batch: int = llm.BATCH,
    ontology: Ontology = Ontology(), model: str = "", tasks: int | None = None, per_second: float | None = None, images: list[str] | None = None,
) -> Graph:
    """The graphs by a language model.

    Answers are kept under ``store`` by what was asked, so a run that failed, or one over
    more documents, asks only what has no answer. ``images`` are folders with the pictures
    that documents show.
    """
    tree = written(tree_nodes(documents, components(documents)), "tree")
    pieces = chunks(tree, split_text, split_paragraphs)
    pictures = llm.image_table(documents.sparkSession, images) if images else None
    ask = lambda prompts: written(llm.answered(llm.with_images(prompts, pictures), make_client, f"{store}/answers", model, batch, tasks, per_second), "answers")
    entities = written(llm.llm_entities(pieces, ask(llm.entity_prompts(pieces, ontology)), ontology), "entities")
    relations = llm.llm_relations(pieces, entities, ask(llm.relation_prompts(pieces, entities, ontology)), ontology)
    return finish(documents, tree, pieces, llm.llm_nodes(entities), llm.llm_mention_edges(entities).unionByName(relations), ontology)


def run(spark: SparkSession, config: BuildConfig) -> DataFrame:
    """Builds, stores and exports what a config names, any number of documents; returns a summary line (``value``) for each."""
    documents = load_documents(spark, config.input_path)
    split = {"split_text": config.split_text_nodes, "split_paragraphs": config.split_text_to_paragraphs}
    if config.extractor == "llm":
        client = functools.partial(llm.ChatClient, config.llm_model, config.llm_api_key, config.llm_base_url, config.llm_temperature)
        client()  # fails here, not in a task, if there is no key
        folders = [r[0] for r in documents.select(F.regexp_extract("source_path", r"\A(.*)/", 1)).distinct().collect()]
        graph = build_with_model(
            documents, client, f"{config.working_dir}/answers", batch=config.llm_batch_size, model=config.llm_model, tasks=config.llm_tasks, per_second=config.llm_per_second, images=folders, **split
        )
    else:
        graph = build(documents, **split)
    persist(graph, f"{config.working_dir}/store")
    index = export_files(graph, config.working_dir)
    named = index.join(graph.stats, "document_id").orderBy("document_name", "document_id")
    return named.select(F.concat("document_name", F.lit(": "), "node_count", F.lit(" nodes, "), "edge_count", F.lit(" edges -> "), "export_path").alias("value"))


#: Options that change a config's fields, with their types; flags have none.
_OPTIONS = {
    "input": ("input_path", str), "working-dir": ("working_dir", str), "graph-backend": ("graph_backend", str), "export": ("export", str), "extractor": ("extractor", str),
    "llm-model": ("llm_model", str), "llm-api-key": ("llm_api_key", str), "llm-base-url": ("llm_base_url", str), "llm-temperature": ("llm_temperature", float),
    "llm-batch-size": ("llm_batch_size", int), "llm-tasks": ("llm_tasks", int), "llm-per-second": ("llm_per_second", float), "split-text-nodes": ("split_text_nodes", None), "split-text-to-paragraphs": ("split_text_to_paragraphs", None),
}


def config_of(arguments: list[str] | None = None) -> BuildConfig:
    """The config that a command line names; its options go before those of a config file."""
    parser = argparse.ArgumentParser(description="Markdown to knowledge graphs")
    parser.add_argument("--config")
    for option, (field, kind) in _OPTIONS.items():
        how = {"type": kind, "default": None} if kind else {"action": "store_true", "default": None}
        parser.add_argument(f"--{option}", dest=field, **how)
    given = {k: v for k, v in vars(parser.parse_args(arguments)).items() if v is not None}
    path = given.pop("config", None)
    if path is None and "input_path" not in given:
        parser.error("--config or --input is needed")
    return BuildConfig(**(vars(load_config(path)) if path else {}) | given)


def main() -> None:
    config = config_of()
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    with owned() as tables:
        for row in run(spark, config).toLocalIterator():
            print(row.value)
    tables.clear(spark)


if __name__ == "__main__":
    main()
