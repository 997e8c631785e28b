"""Types of the tables, and the default ontology."""

from __future__ import annotations

from typing import NamedTuple

#: Closed form of the open metadata of the data model; null stands for an absent key.
META = (
    "document_id string, source_path string, table_body string, table_caption array<string>, img_path string, "
    "image_caption array<string>, note_text string, source_node_id string, source_chunk_id string, mentions array<string>"
)
META_FIELDS = tuple(part.split()[0] for part in META.split(", "))

#: Entity and relation types; fixed values.
ENTITY_TYPES = (
    "memory_product", "memory_family", "interface_standard", "component", "substructure", "timing_parameter", "performance_metric",
    "power_metric", "capacity_metric", "operating_condition", "process_technology", "material", "signal", "test_method", "failure_mode",
    "organization", "IMAGE", "TABLE", "FORMULA", "VIDEO",
)
RELATION_TYPES = (
    "related_to", "part_of", "contains", "connected_to", "interacts_with", "affects", "impacts", "depends_on", "causes", "enables",
    "measured_by", "has_timing", "has_bandwidth", "has_latency", "has_capacity", "consumes_power", "compatible_with", "uses_protocol",
    "specification_of", "tradeoff_with",
)
STRUCTURAL_RELATION_TYPES = ("parent_of", "next_sibling", "contains")
#: Node types that are not text.
ASSETS = ("image", "table", "formula", "video")


class Ontology(NamedTuple):
    """The types that a valid graph may use; structural relations are relations too."""

    entity_types: tuple[str, ...] = ENTITY_TYPES
    relation_types: tuple[str, ...] = tuple(dict.fromkeys(RELATION_TYPES + STRUCTURAL_RELATION_TYPES))
    structural_relation_types: tuple[str, ...] = STRUCTURAL_RELATION_TYPES

    def prompt_relations(self) -> list[str]:
        """Relation types that a language model is offered: all but the structural ones."""
        return sorted(set(self.relation_types) - set(self.structural_relation_types))
