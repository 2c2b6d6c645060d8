"""Validated settings; they stay in the driver and never enter a plan."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, is_dataclass

from textloom.functions import fixed


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass(frozen=True)
class Chunking:
    chunk_size: int = 512
    overlap: int = 64

    def __post_init__(self) -> None:
        _require(self.chunk_size > 0, "chunk_size must be positive")
        _require(self.overlap >= 0, "overlap must not be negative")


@dataclass(frozen=True)
class Retrieval:
    top_k: int = 5
    candidate_k: int = 50
    rrf_k: int = 60
    bm25_weight: float = 1.0
    dense_weight: float = 1.0

    def __post_init__(self) -> None:
        _require(min(self.top_k, self.candidate_k, self.rrf_k) > 0, "top_k, candidate_k and rrf_k must be positive")
        _require(min(self.bm25_weight, self.dense_weight) >= 0, "weights must not be negative")


@dataclass(frozen=True)
class Settings:
    seed: int = 42
    include_drafts: bool = False
    max_doc_share: float = 0.15
    families: tuple = field(default_factory=lambda: tuple((n, tuple(m)) for n, m in fixed.FAMILIES))
    chunking: Chunking = field(default_factory=Chunking)
    retrieval: Retrieval = field(default_factory=Retrieval)

    def __post_init__(self) -> None:
        _require(0 < self.max_doc_share <= 1, "max_doc_share must lie in (0, 1]")


def settings(values: dict, kind: type = Settings):
    """Settings from a mapping; unknown names are an error."""
    known = {f.name: f for f in fields(kind)}
    unknown = sorted(set(values) - set(known))
    _require(not unknown, f"unknown settings: {', '.join(unknown)}")
    parts = {"chunking": Chunking, "retrieval": Retrieval}
    return kind(**{k: settings(v, parts[k]) if k in parts and not is_dataclass(v) else v for k, v in values.items()})


def load(path: str) -> Settings:
    """Settings from a JSON file, or YAML where a parser is installed."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        import yaml

        return settings(yaml.safe_load(text) or {})
    return settings(json.loads(text))
