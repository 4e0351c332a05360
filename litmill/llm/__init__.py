"""Operators for building training corpora, each with its query; nothing else in the library imports this folder."""

from __future__ import annotations

from importlib import import_module

from litmill.llm.registry import ORACLES, QUERIES

_MODULES = (
    "preference", "neighbours", "tokenfiles", "substrings", "pieces",
    "jaccard", "rules", "sharding", "contamination", "personal",
    "divergence", "ranked", "extraction",
)


def load() -> tuple[dict, dict]:
    for module in _MODULES:
        import_module(f"litmill.llm.{module}")
    return QUERIES, ORACLES
