"""Entities and relations by patterns: no model, the same result for the same text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import SPACE, compact_text, is_ascii, normalize_key, stable_id
from graphloom.operators.metadata import meta, with_fields
from graphloom.operators.structural import EDGE_COLUMNS, NODE_COLUMNS, kg_id

_NUMBER = rf"(?iU)\b\d+(?:\.\d+)?{SPACE}*"
#: Entity types in order with their patterns; capacity alone minds the case. Fixed values.
PATTERNS = {
    "memory_product": r"(?iU)\b(?:LPDDR\dX?|DDR\d|GDDR\dX?|HBM\d?|SRAM|DRAM|NAND|DIMM|MRAM|RRAM)\b",
    "interface_standard": r"(?iU)\b(?:PCIe|NVLink|CXL|UCIe|JEDEC|ONFI|NVMe|ECC)\b",
    "timing_parameter": r"(?iU)\b(?:tRCD|tRP|tRAS|tWR|tRFC|tREFI|CL|CAS latency)\b",
    "process_technology": rf"{_NUMBER}(?:nm|µm|um){SPACE}*(?:process|node)?\b",
    "capacity_metric": rf"(?U)\b\d+(?:\.\d+)?{SPACE}*(?:Gb|GB|Tb|TB|Mb|MB)\b",
    "power_metric": rf"{_NUMBER}(?:mW|W|pJ/bit|nJ|V)\b",
    "performance_metric": rf"{_NUMBER}(?:MT/s|GT/s|Gb/s|GB/s|MHz|GHz|ns|ps|%)\b",
    "component": r"(?iU)\b(?:controller|channel|bank|rank|die|base die|PHY|buffer|cache|array|cell|wordline|bitline|TSV|interposer|package|interface|decoder|sense amplifier)\b",
    "material": r"(?iU)\b(?:silicon|copper|oxide|hafnium|carbon|polymer|metal)\b",
}
#: Relation of a pair by the first of these types that it has; fixed values.
RELATIONS = {
    "timing_parameter": "has_timing",
    "capacity_metric": "has_capacity",
    "power_metric": "consumes_power",
    "performance_metric": "specification_of",
    "interface_standard": "uses_protocol",
    "component": "part_of",
}


def _ascii(pattern: str) -> str:
    """A pattern that finds the same in ASCII text, where Unicode classes cost much and find nothing more: a match's first character is looked at first."""
    case, rest = ("(?i)", pattern.removeprefix("(?iU)")) if pattern.startswith("(?iU)") else ("", pattern.removeprefix("(?U)"))
    words = rest.removeprefix(r"\b(?:")
    first = r"\d" if words == rest else "[" + "".join(sorted({w[0] for w in words.split("|")})) + "]"
    return f"{case}(?={first}){rest}"


#: Only texts that one of the patterns finds are read by each.
_GATE = "|".join(rf"(?:{p})" for p in PATTERNS.values())
_ASCII_PATTERNS = {k: _ascii(p) for k, p in PATTERNS.items()}
_ASCII_GATE = "|".join(rf"(?:{p})" for p in _ASCII_PATTERNS.values())
#: What nodes and edges of mentions take from their chunk, beside its text.
_KEPT = ["document_id", "source_path", "idx", "piece_idx", "chunk_id", "node_id", "node_type", "tree_path", "metadata"]
PAIRED = 8  # entities of a chunk that form pairs
EVIDENCE = 500


def matches(text: Column | str) -> Column:
    """All matches of a text as (entity_type, name), in the order of the types, then of places."""
    text = F.col(text) if isinstance(text, str) else text
    none = F.array().cast("array<struct<entity_type:string,name:string>>")
    return F.when(_any(text), _matches(text)).otherwise(none)


def _any(text: Column) -> Column:
    """Whether any pattern finds something."""
    return F.when(is_ascii(text), text.rlike(_ASCII_GATE)).otherwise(text.rlike(_GATE))


def _matches(text: Column) -> Column:
    found = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    of = lambda kind, pattern: F.transform(found(pattern), lambda m: F.struct(F.lit(kind).alias("entity_type"), compact_text(m).alias("name")))
    all_ = lambda patterns: F.flatten(F.array(*(of(k, p) for k, p in patterns.items())))
    return F.when(is_ascii(text), all_(_ASCII_PATTERNS)).otherwise(all_(PATTERNS))


def _sentences(text: Column) -> Column:
    return F.split(text, rf"(?U)(?<=[。.!?]){SPACE}+|\n+", -1)


def mentions(chunks: DataFrame) -> DataFrame:
    """The chunks' columns with (text, pos, entity_type, name, evidence): distinct entities of each chunk."""
    rows, told = _told(chunks)
    return rows.select("*", F.inline(told)).drop("entities", "sentences")


def chunk_mentions(chunks: DataFrame) -> DataFrame:
    """The mentions of each chunk that has any as the array ``told`` of one row, with what nodes and edges take from the chunk.

    To be stored and dealt: a chunk's text (its start, as evidence) and metadata stand once,
    not beside each mention. ``each_mention`` gives the rows of ``mentions``.
    """
    rows, told = _told(chunks)
    return rows.select(*_KEPT, F.substring("text", 1, EVIDENCE).alias("text"), told.alias("told"))


def each_mention(stored: DataFrame) -> DataFrame:
    """One row for each mention of stored ``chunk_mentions``."""
    return stored.select(*_KEPT, "text", F.inline("told"))


def _told(chunks: DataFrame) -> tuple[DataFrame, Column]:
    """Chunks with a match, and what tells their entities.

    An entity stands at its first match and is written as its last one; its evidence is
    the first sentence that holds its name in any case, else the whole text, compact and
    of 500 characters at most. All of it is found inside the chunk's row: matches stand
    sorted by key and place, so that neighbours tell where a key begins and ends. The
    filter asks the gate alone and the generator takes an expression, not a column: a
    filter on made columns would move below and make each of them again.
    """
    texts = chunks.withColumn("text", compact_text("content"))
    found = texts.where(_any(F.col("text"))).withColumn("matches", _matches(F.col("text")))
    keyed = F.transform("matches", lambda m, i: F.struct(normalize_key(F.concat(m["entity_type"], F.lit(":"), m["name"])).alias("key"), i.alias("nth"), m.alias("m")))
    sorted_ = found.withColumn("sorted", F.array_sort(keyed))
    key_at = lambda i: F.get("sorted", i)["key"]
    first = F.filter("sorted", lambda m, i: (i == 0) | (key_at(i - 1) != m["key"]))
    last = F.filter("sorted", lambda m, i: (i == F.size("sorted") - 1) | (key_at(i + 1) != m["key"]))
    each = F.array_sort(F.zip_with(first, last, lambda a, z: F.struct(a["nth"].alias("first"), z["m"].alias("m"), F.lower(z["m"]["name"]).alias("lower"))))
    short = lambda s: F.substring(compact_text(s), 1, EVIDENCE)
    lower = F.transform(_sentences(F.col("text")), lambda s: F.struct(F.lower(s).alias("lower"), short(s).alias("s")))
    rows = sorted_.withColumns({"entities": each, "sentences": lower}).drop("matches", "sorted")

    def evidence(name: Column) -> Column:
        stands = F.get(F.filter("sentences", lambda s: F.contains(s["lower"], name)), 0)["s"]
        return F.coalesce(stands, short(F.col("text")))

    told = F.transform("entities", lambda e, i: F.struct((i + 1).alias("pos"), e["m"]["entity_type"].alias("entity_type"), e["m"]["name"].alias("name"), evidence(e["lower"]).alias("evidence")))
    return rows, told


def _entity_id(clustered: bool, entity_type: Column | str = "entity_type", name: Column | str = "name") -> Column:
    """An entity's id, or with ``clustered`` that of its cluster.

    Names that patterns find begin with a letter or digit, so that equal ids have equal
    clusters: the key of type and name is the type's key and then the name's.
    """
    if clustered:
        return stable_id("document_id", normalize_key(F.concat(entity_type, F.lit(":"), name)), prefix="ent-")
    return stable_id("document_id", entity_type, normalize_key(name), prefix="ent-")


def entity_nodes(found: DataFrame, clustered: bool = False) -> DataFrame:
    """One semantic node for each mention."""
    evidence = F.col("evidence")
    return found.select(
        "document_id", F.array(F.lit(1), "idx", "piece_idx", "pos").alias("seq"), _entity_id(clustered).alias("id"), "name", "entity_type",
        F.concat("name", F.lit(" mentioned in "), "tree_path").alias("description"), F.lit("semantic").alias("kind"), evidence.alias("evidence_span"),
        F.when(evidence != "", "grounded").otherwise("missing").alias("evidence_status"), F.lit("unknown").alias("ontology_status"), "tree_path", "source_path",
        F.lit("").alias("source_trace_id"), F.when(F.col("node_type").isin("image", "table"), F.col("node_type")).otherwise("text").alias("modality"),
        with_fields(F.col("metadata"), source_node_id=F.coalesce("metadata.source_node_id", "node_id")).alias("metadata"),
    ).select(*NODE_COLUMNS)


def mention_edges(found: DataFrame, clustered: bool = False) -> DataFrame:
    """contains from the tree node of each mention to its entity."""
    rows = found.select("*", kg_id("node_id").alias("src"), _entity_id(clustered).alias("tgt"), F.col("evidence").alias("evidence_span"))
    return rows.select(
        "document_id", F.array(F.lit(1), "idx", "piece_idx", F.lit(0), "pos").alias("seq"), stable_id("document_id", "src", "tgt", F.lit("contains"), prefix="edge-").alias("id"),
        "src", "tgt", F.lit("contains").alias("relation_type"), F.concat("tree_path", F.lit(" contains mention of "), "name").alias("description"),
        F.lit("extracted").alias("edge_source"), "evidence_span", F.when(F.col("evidence_span") != "", "grounded").otherwise("missing").alias("evidence_status"),
        F.lit("unknown").alias("ontology_status"), F.lit(0.85).alias("confidence"), "tree_path", "source_path", meta(source_node_id=F.col("node_id")).alias("metadata"),
    ).select(*EDGE_COLUMNS)


def relation_of(a: Column, b: Column) -> Column:
    """The relation of two entity types, in either order."""
    out = F.lit("related_to")
    for kind, relation in reversed(RELATIONS.items()):
        out = F.when((a == kind) | (b == kind), relation).otherwise(out)
    return out


def pair_edges(found: DataFrame, clustered: bool = False) -> DataFrame:
    """Relations between the first eight entities of each chunk, made inside its row; ``chunk_mentions`` are not grouped anew."""
    keys = ["document_id", "source_path", "idx", "piece_idx", "chunk_id", "tree_path"]
    if "told" in found.columns:
        each = F.transform(F.slice("told", 1, PAIRED), lambda e: F.struct(e["pos"].alias("pos"), _entity_id(clustered, e["entity_type"], e["name"]).alias("id"), e["entity_type"].alias("entity_type")))
        rows = found.select(*keys, each.alias("es"), "text")
    else:
        entity = F.struct("pos", _entity_id(clustered).alias("id"), "entity_type")
        rows = found.where(F.col("pos") <= PAIRED).groupBy(*keys).agg(F.sort_array(F.collect_list(entity)).alias("es"), F.first("text").alias("text"))
    pairs = F.flatten(F.transform("es", lambda a: F.transform(F.filter("es", lambda b: b["pos"] > a["pos"]), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    each = rows.select(*keys, "text", F.explode(pairs).alias("p")).withColumn("relation_type", relation_of(F.col("p.a.entity_type"), F.col("p.b.entity_type")))
    return each.select(
        "document_id", F.array(F.lit(1), "idx", "piece_idx", F.lit(1), "p.a.pos", "p.b.pos").alias("seq"),
        stable_id("document_id", "p.a.id", "p.b.id", "relation_type", "chunk_id", prefix="edge-").alias("id"), F.col("p.a.id").alias("src"), F.col("p.b.id").alias("tgt"),
        "relation_type", F.concat("p.a.entity_type", F.lit(" and "), "p.b.entity_type", F.lit(" co-occur in "), "tree_path").alias("description"),
        F.lit("extracted").alias("edge_source"), F.substring("text", 1, EVIDENCE).alias("evidence_span"), F.lit("grounded").alias("evidence_status"),
        F.lit("unknown").alias("ontology_status"), F.lit(0.6).alias("confidence"), "tree_path", "source_path", meta(source_chunk_id=F.col("chunk_id")).alias("metadata"),
    ).select(*EDGE_COLUMNS)
