"""Extraction by a language model: ask, keep the raw answers, parse them as columns.

Answers are asked for in tasks, a bounded number at a time, and kept in a table of their
own by what was asked, so that no answer is paid for twice.
"""

from __future__ import annotations

import asyncio
import json
import math
import os
import time
import unicodedata
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.text import SPACE, compact_text, normalize_key, stable_id, strip
from graphloom.operators.metadata import meta, with_fields
from graphloom.operators.structural import EDGE_COLUMNS, NODE_COLUMNS, kg_id
from graphloom.plans.schema import Ontology
from graphloom.scratch import exists, written
from graphloom.sources.documents import plain_path

BATCH = 16
#: Delimiters of the answers; fixed values.
FIELD, RECORD, DONE = "<|>", "##", "<|COMPLETE|>"
CJK = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]"


class Client(Protocol):
    """Anything that answers a prompt, with an image's data URL if there is one."""

    async def generate(self, prompt: str, *, image_data_url: str | None = None) -> str: ...


@dataclass(frozen=True)
class ChatClient:
    """A client of servers that speak the chat completions protocol."""

    model: str
    api_key: str | None = None
    base_url: str | None = None
    temperature: float | None = None
    timeout: float = 120.0

    def __post_init__(self) -> None:
        if not (self.api_key or os.getenv("OPENAI_API_KEY")):
            raise ValueError("an API key is needed: set OPENAI_API_KEY or pass api_key")

    def payload(self, prompt: str, image_data_url: str | None = None) -> dict:
        content: object = prompt
        if image_data_url:
            content = [{"type": "text", "text": prompt}, {"type": "image_url", "image_url": {"url": image_data_url}}]
        body = {"model": self.model, "messages": [{"role": "user", "content": content}]}
        return body if self.temperature is None else body | {"temperature": self.temperature}

    def _post(self, body: dict) -> str:
        url = (self.base_url or os.getenv("OPENAI_BASE_URL") or "https://api.openai.com/v1").rstrip("/") + "/chat/completions"
        headers = {"Authorization": f"Bearer {self.api_key or os.environ['OPENAI_API_KEY']}", "Content-Type": "application/json"}
        with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=self.timeout) as answer:
            return str(json.load(answer)["choices"][0]["message"]["content"])

    async def generate(self, prompt: str, *, image_data_url: str | None = None) -> str:
        return await asyncio.to_thread(self._post, self.payload(prompt, image_data_url))


def _braced(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}"))


def entity_prompt(ontology: Ontology) -> Column:
    """The prompt that asks for a chunk's entities."""
    language = F.when(F.col("content").rlike(CJK), "Chinese").otherwise("English")
    rule = F.when(F.col("node_type") == "text", "Quote for each entity a short passage of the text, word for word; leave out entities without one.").otherwise("Use what the picture or table shows, with its caption; a passage may be missing for what is only seen.")
    return F.concat(
        F.lit(f"List the technical entities of the passage. Types: {', '.join(sorted(ontology.entity_types))}.\nAnswer in "), language, F.lit(". "), rule,
        F.lit(f'\nOne record each, parted by {RECORD}: ("entity"{FIELD}name{FIELD}type{FIELD}description{FIELD}passage). End with {DONE}.\nPlace: '),
        _braced(F.col("tree_path")), F.lit("\nPassage:\n"), _braced(F.col("content")),
    )


def relation_prompt(ontology: Ontology, names: Column) -> Column:
    """The prompt that asks for relations between a chunk's entities."""
    return F.concat(
        F.lit(f"List the relations between these entities that the passage states. Types: {', '.join(ontology.prompt_relations())}.\nEntities: "),
        _braced(F.array_join(names, ", ")),
        F.lit(f'\nOne record each, parted by {RECORD}: ("relationship"{FIELD}source{FIELD}target{FIELD}type{FIELD}description{FIELD}passage{FIELD}confidence). End with {DONE}.\nPassage:\n'),
        _braced(F.col("content")),
    )


#: Media types by the ends of file names; fixed values.
_MEDIA = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "svg": "image/svg+xml", "tif": "image/tiff", "tiff": "image/tiff"}


def image_table(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(image_path, image_data_url) of the pictures below some folders, of any file system that Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(x for k in _MEDIA for x in (k, k.upper())) + "}").load(folders)
    media = F.create_map(*(F.lit(x) for pair in _MEDIA.items() for x in pair))
    kind = F.coalesce(F.try_element_at(media, F.lower(F.regexp_extract("path", r"\.(\w+)\z", 1))), F.lit("application/octet-stream"))
    return files.select(plain_path(F.col("path")).alias("image_path"), F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.base64("content")).alias("image_data_url"))


def with_images(prompts: DataFrame, images: DataFrame | None) -> DataFrame:
    """The prompts with ``image_data_url``, and ``image_error`` where an image_path has no file; such prompts are asked without it."""
    none = F.lit(None).cast("string")
    if images is None:
        met = prompts.withColumn("image_data_url", none)
    else:
        shown = prompts.where(F.col("image_path").isNotNull()).join(images.dropDuplicates(["image_path"]), "image_path", "left")
        met = shown.unionByName(prompts.where(F.col("image_path").isNull()).withColumn("image_data_url", none))
    missing = F.col("image_path").isNotNull() & (F.col("image_path") != "") & F.col("image_data_url").isNull()
    return met.withColumn("image_error", F.when(missing, F.concat(F.lit("no image at "), "image_path")))


def ask(prompts: DataFrame, make_client: Callable[[], Client], batch: int = BATCH, tasks: int | None = None, per_second: float | None = None) -> DataFrame:
    """(document_id, chunk_id, response, error) of (document_id, chunk_id, prompt, image_data_url) rows.

    ``make_client`` runs in each task. A failed prompt has an error and an empty
    response, and does not touch the others. With ``tasks`` the prompts are dealt evenly
    over so many, and at most tasks x batch run at a time; ``per_second`` then bounds the
    rate of all tasks together.
    """
    if per_second is not None and tasks is None:
        raise ValueError("a rate needs a number of tasks")

    async def one(client: Client, prompt: str, image: str | None) -> tuple[str, str | None]:
        try:
            return await client.generate(prompt, image_data_url=image), None
        except Exception as e:  # whatever a client raises stays with its prompt
            return "", str(e)

    async def all_of(client: Client, rows: pd.DataFrame) -> list[tuple[str, str | None]]:
        return await asyncio.gather(*(one(client, r.prompt, r.image_data_url or None) for r in rows.itertuples()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for rows in batches:
            for at in range(0, len(rows), max(1, batch)):
                part = rows.iloc[at : at + max(1, batch)]
                began = time.monotonic()
                answers = asyncio.run(all_of(client, part))
                if per_second is not None:
                    time.sleep(max(0.0, len(part) * tasks / per_second - (time.monotonic() - began)))
                yield part[["document_id", "chunk_id"]].assign(response=[a for a, _ in answers], error=[e for _, e in answers])

    columns = prompts.select("document_id", "chunk_id", "prompt", "image_data_url")
    columns = columns.repartition(tasks) if tasks else columns
    return columns.mapInPandas(run, "document_id string, chunk_id string, response string, error string")


#: Prompts of one job, of which a run that fails may have to ask all again; with over MOST_ROUNDS such jobs later ones are larger.
ROUND = 20_000
#: Rounds of a run, but for the first small ones.
MOST_ROUNDS = 32
_ANSWERS = "key string, response string, error string, attempt int"


def _rounds(n: int) -> Iterator[tuple[int, int]]:
    """Ranges of n shares: each may be twice the one before, up to a share of all, since every round reads all prompts that are left."""
    first, width, most = 0, 1, math.ceil(n / MOST_ROUNDS)
    while first < n:
        end = min(n, first + width)
        yield first, end
        first, width = end, min(2 * width, most)


def answered(
    prompts: DataFrame, make_client: Callable[[], Client], store: str, model: str = "", batch: int = BATCH, tasks: int | None = None, per_second: float | None = None,
    retries: int = 2, round_size: int = ROUND,
) -> DataFrame:
    """(document_id, chunk_id, response, error, image_error) of ``with_images`` prompts, each distinct one asked once.

    Answers are kept in the table ``store`` by the hash of prompt, image and model. Only
    prompts without an answer are asked, ``round_size`` at a time, later at most a
    ``MOST_ROUNDS``-th of them: a run that fails keeps all rounds before. Failed prompts are asked again up to ``retries`` times in a run; what
    still fails has an empty response and its last error.
    """
    spark = prompts.sparkSession
    key = F.sha2(F.concat_ws("\x00", F.lit(model), "prompt", F.coalesce("image_data_url", F.lit(""))), 256)
    keyed = written(prompts.withColumn("key", key), "prompts")

    def known() -> DataFrame:
        return spark.read.schema(_ANSWERS).parquet(store) if exists(spark, store) else spark.createDataFrame([], _ANSWERS)

    for attempt in range(1 + retries):
        left = keyed.join(known().where("error IS NULL").select("key").distinct(), "key", "left_anti").dropDuplicates(["key"])
        left = written(left.select(F.col("key").alias("document_id"), F.col("key").alias("chunk_id"), "prompt", "image_data_url"), "unanswered")
        rounds = math.ceil(left.count() / round_size)
        for first, end in _rounds(rounds):
            part = left.where(F.pmod(F.xxhash64("chunk_id"), F.lit(rounds)).between(first, end - 1))
            found = ask(part, make_client, batch, tasks, per_second)
            found.select(F.col("chunk_id").alias("key"), "response", "error", F.lit(attempt).alias("attempt")).write.mode("append").parquet(store)
        if not rounds:
            break
    best = known().groupBy("key").agg(F.max_by(F.struct("response", "error"), F.struct(F.col("error").isNull(), "attempt", "response")).alias("a"))
    return keyed.join(best, "key").select("document_id", "chunk_id", "a.response", "a.error", "image_error")


def records(answers: DataFrame) -> DataFrame:
    """The answers' columns with (record, fields): each record's fields without wrapping quotes."""
    parts = F.split(compact_text("response"), r"##|<\|COMPLETE\|>", -1)
    rows = answers.select("*", F.posexplode(F.filter(F.transform(parts, strip), lambda p: p != "")).alias("record", "part"))
    inner = F.regexp_extract("part", r"(?s)\((.*)\)", 1)

    def unquoted(bare: Column) -> Column:
        quoted = bare.rlike(r"(?s)\A([\"']).*\1\z") & (F.length(bare) >= 2)
        return compact_text(F.when(quoted, bare.substr(F.lit(2), F.length(bare) - 2)).otherwise(bare))

    fields = F.transform(F.transform(F.split(strip(inner), r"<\|>", -1), strip), unquoted)
    return rows.where(F.col("part").rlike(r"(?s)\(.*\)")).withColumn("fields", fields).drop("part")


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition, which SQL does not have."""
    return texts.map(lambda t: t if t and t.isascii() else unicodedata.normalize("NFKC", t or ""))


def plain(text: Column) -> Column:
    """A text up to compatible characters, white space and case."""
    return F.lower(strip(F.regexp_replace(nfkc(compact_text(text)), rf"(?U){SPACE}+", " ")))


def supported(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows whose evidence_span stands in their chunk's content, with the chunk's columns; evidence on other media is trusted.

    Each chunk is normalised once, before its records meet it, and each distinct passage
    of a row once. The hint is for chunks whose files are small: texts made from them, many
    times as large, would be held in the driver to be broadcast.
    """
    read = chunks.withColumn("_content", plain(F.col("content"))).hint("merge")
    met = rows.withColumn("_evidence", plain(F.col("evidence_span"))).join(read, ["document_id", "chunk_id"])
    stands = (F.col("_evidence") != "") & F.contains("_content", F.col("_evidence"))
    return met.where((F.col("node_type") != "text") | stands).drop("_content", "_evidence")


def canonical_type(value: Column, types: tuple[str, ...]) -> Column:
    """The type whose normalised name equals the value's; null if none."""
    table = F.create_map(*(x for t in types for x in (normalize_key(F.lit(t)), F.lit(t))))
    return F.try_element_at(table, normalize_key(value))


def confidence(value: Column) -> Column:
    """A number from 0 to 1; 0.5 for what is none, 1 for NaN."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value.try_cast("double"), F.lit(0.5))))


def llm_entities(chunks: DataFrame, answers: DataFrame, ontology: Ontology = Ontology()) -> DataFrame:
    """The chunks' columns with (pos, id, name, entity_type, description, evidence_span) of valid entity records."""
    f = F.col("fields")
    parsed = records(answers).where((F.size(f) == 5) & (normalize_key(F.get(f, 0)) == "entity"))
    named = parsed.select("document_id", "chunk_id", F.col("record").alias("pos"), F.get(f, 1).alias("name"), canonical_type(F.get(f, 2), ontology.entity_types).alias("entity_type"), F.get(f, 3).alias("description"), F.get(f, 4).alias("evidence_span"))
    kept = supported(named.where("name <> '' AND entity_type IS NOT NULL"), chunks)
    return kept.withColumn("id", stable_id("document_id", "entity_type", normalize_key("name"), prefix="ent-"))


def llm_nodes(entities: DataFrame) -> DataFrame:
    """Semantic nodes of entity records."""
    return entities.select(
        "document_id", F.array(F.lit(1), "idx", "piece_idx", "pos").alias("seq"), "id", "name", "entity_type", "description", F.lit("semantic").alias("kind"), "evidence_span",
        F.when(F.col("evidence_span") != "", "grounded").otherwise("missing").alias("evidence_status"), F.lit("unknown").alias("ontology_status"), "tree_path", "source_path",
        F.lit("").alias("source_trace_id"), F.when(F.col("node_type").isin("image", "table"), F.col("node_type")).otherwise("text").alias("modality"),
        with_fields(F.col("metadata"), source_node_id=F.coalesce("metadata.source_node_id", "node_id")).alias("metadata"),
    ).select(*NODE_COLUMNS)


def llm_mention_edges(entities: DataFrame) -> DataFrame:
    """contains from each chunk's tree node to its entities."""
    rows = entities.select("*", kg_id("node_id").alias("src"), F.col("id").alias("tgt"))
    return rows.select(
        "document_id", F.array(F.lit(1), "idx", "piece_idx", F.lit(0), "pos").alias("seq"), stable_id("document_id", "src", "tgt", F.lit("contains"), prefix="edge-").alias("id"), "src", "tgt",
        F.lit("contains").alias("relation_type"), F.concat("tree_path", F.lit(" contains mention of "), "name").alias("description"), F.lit("extracted").alias("edge_source"), "evidence_span",
        F.when(F.col("evidence_span") != "", "grounded").otherwise("missing").alias("evidence_status"), F.lit("unknown").alias("ontology_status"), F.lit(0.9).alias("confidence"),
        "tree_path", "source_path", meta(source_node_id=F.col("node_id")).alias("metadata"),
    ).select(*EDGE_COLUMNS)


def llm_relations(chunks: DataFrame, entities: DataFrame, answers: DataFrame, ontology: Ontology = Ontology()) -> DataFrame:
    """Edges of valid relationship records: both names are the chunk's entities, not the same, and evidence is there."""
    f = F.col("fields")
    parsed = records(answers).where((F.size(f) == 7) & (normalize_key(F.get(f, 0)) == "relationship"))
    rows = parsed.select(
        "document_id", "chunk_id", "record", normalize_key(F.get(f, 1)).alias("src_key"), normalize_key(F.get(f, 2)).alias("tgt_key"),
        canonical_type(F.get(f, 3), ontology.relation_types).alias("relation_type"), F.get(f, 4).alias("description"), F.get(f, 5).alias("evidence_span"), confidence(F.get(f, 6)).alias("confidence"),
    )
    last = entities.groupBy("document_id", "chunk_id", normalize_key("name").alias("key")).agg(F.max_by("id", "pos").alias("end"))
    for end in ("src", "tgt"):
        rows = rows.join(last.select("document_id", "chunk_id", F.col("key").alias(f"{end}_key"), F.col("end").alias(end)).hint("merge"), ["document_id", "chunk_id", f"{end}_key"])
    kept = supported(rows.where("src <> tgt AND relation_type IS NOT NULL AND evidence_span <> ''"), chunks)
    return kept.select(
        "document_id", F.array(F.lit(1), "idx", "piece_idx", F.lit(1), "record").alias("seq"), stable_id("document_id", "src", "tgt", "relation_type", "chunk_id", prefix="edge-").alias("id"),
        "src", "tgt", "relation_type", "description", F.lit("extracted").alias("edge_source"), "evidence_span", F.lit("grounded").alias("evidence_status"),
        F.lit("unknown").alias("ontology_status"), "confidence", "tree_path", "source_path", meta(source_chunk_id=F.col("chunk_id")).alias("metadata"),
    ).select(*EDGE_COLUMNS)


def entity_prompts(chunks: DataFrame, ontology: Ontology = Ontology()) -> DataFrame:
    """Prompts of all chunks but blank texts."""
    asked = chunks.where((F.col("node_type") != "text") | (compact_text("content") != ""))
    return asked.select("document_id", "chunk_id", entity_prompt(ontology).alias("prompt"), F.when(F.col("node_type") == "image", F.col("metadata.img_path")).alias("image_path"))


def relation_prompts(chunks: DataFrame, entities: DataFrame, ontology: Ontology = Ontology()) -> DataFrame:
    """Prompts of the chunks that have an entity, naming all of them in order."""
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("pos", "name"))), lambda e: e["name"])
    named = entities.groupBy("document_id", "chunk_id").agg(in_order.alias("names"))
    asked = chunks.join(named.hint("merge"), ["document_id", "chunk_id"])
    return asked.select("document_id", "chunk_id", relation_prompt(ontology, F.col("names")).alias("prompt"), F.when(F.col("node_type") == "image", F.col("metadata.img_path")).alias("image_path"))
