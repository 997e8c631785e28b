"""Building the closed metadata struct."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.plans.schema import META


def _fields() -> list[tuple[str, str]]:
    return [tuple(part.split(" ", 1)) for part in META.split(", ")]


def meta(**values: Column) -> Column:
    """A metadata struct with these fields, all others null."""
    return F.struct(*(values.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in _fields()))


def with_fields(base: Column, **values: Column) -> Column:
    """The struct with some fields replaced."""
    return F.struct(*((values[name] if name in values else base[name]).cast(kind).alias(name) for name, kind in _fields()))
