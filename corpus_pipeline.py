"""A corpus pipeline of five stages over the operators of ``graphloom.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as
Parquet to the shared folder and reads it again as the next stage's docs. All stages
but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.bpe import bpe_round_trip
from graphloom.llm.common import SPACES, written
from graphloom.llm.decontaminate import decontaminate
from graphloom.llm.langid import UNKNOWN, predict, sample, train
from graphloom.llm.line_dedup import line_dedup
from graphloom.llm.simhash import simhash_groups
from graphloom.scratch import owned

#: Documents whose language is less likely than this are rejected.
MIN_LANGUAGE_SCORE = 0.5


def _like_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``documents`` with a new text and its length."""
    return docs.select("doc_id", F.col(text).alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that can be told; ``lang`` becomes the one found.

    Learns from the rows that have a language; without any, every document stays as it is.
    A document whose text is null, empty or has no letter goes. Texts are read whole,
    repeated rows share their fate, and an empty table stays one.
    """
    model = train(sample(docs, F.lit(True)))
    if model is None:
        return docs
    found = predict(docs, model).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return found.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that repeat across documents; a document that loses all but blank lines goes.

    A null text counts as an empty one, which loses nothing and stays as an empty text.
    Lines of very long texts are dropped like others. Rows that repeat an id count as one
    document, and come out once each. Of clashing columns only those of ``documents`` stay.
    """
    out = line_dedup(docs)
    return _like_documents(out.where((F.col("n_dropped") == 0) | (F.trim("kept", F.lit(SPACES)) != "")), "kept")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies.

    Of rows that share that id one stays, chosen by the hash of its text. In groups whose
    ids are all null one row of each fingerprint stays. Documents without words are one group.
    """
    uid = F.xxhash64("text")
    groups = simhash_groups(docs.select("doc_id", "text", uid.alias("uid")), keep=("uid",))
    lead = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    unnamed = F.when(F.col("component_id").isNull(), F.col("fp"))
    lead = lead.groupBy("doc_id", unnamed.alias("unnamed")).agg(F.min("uid").alias("of")).select(F.col("doc_id").alias("lead"), "of")
    kept = docs.withColumn("uid", uid).join(lead, F.col("doc_id").eqNullSafe(F.col("lead")) & (F.col("uid") == F.col("of")), "left_semi")
    # Rows that repeat id and text are one document.
    return kept.groupBy("doc_id", "uid").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("row")).select("doc_id", "row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item.

    A null or empty text holds none. Texts are read whole; repeated rows share their fate;
    without items every document stays.
    """
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~F.col("contaminated")).select("doc_id", "text", "lang", "source", "n_chars")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their number, and digests of them and of the bytes they decode to.

    A null text is an empty one, without ids. Texts are read whole; repeated rows come out
    repeated. Other columns are not used.
    """
    coded = bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    n = (F.octet_length("ids") / 4).cast("long")
    return coded.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [
    ("language", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("bpe", encode),
]

#: Naive Bayes and the recursive merges have no SQL form; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; what a stage needed goes once it is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        label = f"stage-{name}"
        with owned() as tables:
            docs = written(stage(spark, docs, sf_dir), label)
        tables.clear(spark, but=label)
        if before is not None:
            before.clear(spark)
        before = tables
    return docs
