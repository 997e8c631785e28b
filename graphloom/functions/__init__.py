"""Scalar functions as Column expressions."""

from graphloom.functions.text import compact_text, merge_lines, normalize_key, slugify, stable_id, strip, type_color

__all__ = ["compact_text", "merge_lines", "normalize_key", "slugify", "stable_id", "strip", "type_color"]
