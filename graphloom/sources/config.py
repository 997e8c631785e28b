"""Configuration of a build."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class BuildConfig:
    input_path: str
    working_dir: str = "cache/graphloom"
    graph_backend: str = "parquet"
    export: str = "json"
    split_text_nodes: bool = False
    split_text_to_paragraphs: bool = False
    extractor: str = "heuristic"
    llm_model: str | None = None
    llm_api_key: str | None = None
    llm_base_url: str | None = None
    llm_temperature: float | None = None
    llm_batch_size: int = 16
    llm_tasks: int | None = None
    llm_per_second: float | None = None

    def __post_init__(self) -> None:
        if self.graph_backend != "parquet":
            raise ValueError(f"unknown graph backend: {self.graph_backend}")
        if self.export != "json":
            raise ValueError(f"unknown export: {self.export}")
        if self.extractor not in ("heuristic", "llm"):
            raise ValueError(f"unknown extractor: {self.extractor}")
        if self.extractor == "llm" and not self.llm_model:
            raise ValueError("the llm extractor needs llm.model")
        if self.llm_per_second is not None and self.llm_tasks is None:
            raise ValueError("a rate of model calls needs a number of tasks")


#: Field: (section, key in the section, key at the top level).
_NESTED = {
    "split_text_nodes": ("tree", "split_text_nodes", "split_text_nodes"),
    "split_text_to_paragraphs": ("tree", "split_text_to_paragraphs", "split_text_to_paragraphs"),
    "extractor": ("extraction", "extractor", "extractor"),
    "llm_model": ("llm", "model", "llm_model"),
    "llm_api_key": ("llm", "api_key", "llm_api_key"),
    "llm_base_url": ("llm", "base_url", "llm_base_url"),
    "llm_temperature": ("llm", "temperature", "llm_temperature"),
    "llm_batch_size": ("extraction", "batch_size", "llm_batch_size"),
    "llm_tasks": ("extraction", "tasks", "llm_tasks"),
    "llm_per_second": ("extraction", "per_second", "llm_per_second"),
}


def config_from(data: Any) -> BuildConfig:
    """A config from a mapping; keys of a section go before those at the top level."""
    if not isinstance(data, dict):
        raise ValueError("a config must be a mapping")
    values = {"input_path": data.get("input") or data.get("input_path")}
    if not values["input_path"]:
        raise ValueError("a config must have `input` or `input_path`")
    values |= {k: str(data[k]) for k in ("working_dir", "graph_backend", "export") if k in data}
    for field, (section, key, top) in _NESTED.items():
        nested = data.get(section)
        if isinstance(nested, dict) and key in nested:
            values[field] = nested[key]
        elif top in data:
            values[field] = data[top]
    try:
        size = int(values.get("llm_batch_size", 16))
    except (TypeError, ValueError):
        size = 16
    values["llm_batch_size"] = size if size > 0 else 16
    if values.get("llm_temperature") is not None:
        values["llm_temperature"] = float(values["llm_temperature"])
    for key, kind in (("llm_tasks", int), ("llm_per_second", float)):
        if values.get(key) is not None:
            values[key] = kind(values[key])
    for flag in ("split_text_nodes", "split_text_to_paragraphs"):
        values[flag] = bool(values.get(flag, False))
    return BuildConfig(**values | {"input_path": str(values["input_path"])})


def load_config(path: str) -> BuildConfig:
    """A YAML config file, or a JSON one where PyYAML is not installed."""
    at = Path(path).expanduser().resolve()
    if not at.is_file():
        raise FileNotFoundError(at)
    text = at.read_text(encoding="utf-8")
    try:
        import yaml
    except ImportError:
        import json

        return config_from(json.loads(text or "{}"))
    return config_from(yaml.safe_load(text) or {})
