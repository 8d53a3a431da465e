"""Settings: a frozen tree with dotted access, read from YAML-like mappings and the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

#: Environment variable and the setting it overrides.
ENVIRONMENT = {"OPENAI_API_KEY": "openai.api_key", "GROQ_API_KEY": "groq.api_key", "GEMINI_API_KEY": "gemini.api_key"}
_TRUE = frozenset({"true", "1", "yes", "on"})

DEFAULTS: dict[str, Any] = {
    "chunking": {"chunk_size": 800, "chunk_overlap": 150, "min_chunk_size": 200},
    "vector_store": {"index_type": "flat", "distance_metric": "cosine", "dimension": 64},
    "retrieval": {"top_k": 5, "rerank": True, "rerank_top_k": 15, "strategy": "hybrid", "multi_hop": True, "max_hops": 2, "parents": True},
    "generation": {"min_confidence_threshold": 0.3, "citation_format": "section_page"},
}


def cast(value: str, kind: type) -> Any:
    """An environment string as the kind; booleans are true, 1, yes or on, case ignored."""
    return value.strip().lower() in _TRUE if kind is bool else kind(value)


def _merged(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    out = dict(base)
    for key, value in over.items():
        out[key] = _merged(out[key], value) if isinstance(value, Mapping) and isinstance(out.get(key), Mapping) else value
    return out


@dataclass(frozen=True)
class Config:
    tree: Mapping[str, Any] = field(default_factory=lambda: DEFAULTS)

    @classmethod
    def load(cls, settings: Mapping[str, Any] | None = None, environment: Mapping[str, str] | None = None) -> Config:
        """Defaults, then the settings, then keys from the environment."""
        tree, environment = _merged(DEFAULTS, settings or {}), os.environ if environment is None else environment
        for name, place in ENVIRONMENT.items():
            if environment.get(name):
                section, key = place.split(".")
                tree = _merged(tree, {section: {key: environment[name]}})
        return cls(tree)

    @classmethod
    def from_yaml(cls, path: str) -> Config:
        """Read a YAML file, where a YAML library is installed."""
        import yaml

        with open(path) as file:
            return cls.load(yaml.safe_load(file))

    def get(self, place: str, default: Any = None) -> Any:
        """The value at a dotted place, or the default."""
        at: Any = self.tree
        for part in place.split("."):
            if not isinstance(at, Mapping) or part not in at:
                return default
            at = at[part]
        return at

    def validate(self) -> None:
        if self.get("vector_store.index_type") not in ("flat", "ivf"):
            raise ValueError("index_type must be flat or ivf")
        if self.get("chunking.chunk_overlap") >= self.get("chunking.chunk_size"):
            raise ValueError("the overlap must be smaller than a chunk")
