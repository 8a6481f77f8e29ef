"""Queries of this subpackage and the SQL they are checked against."""
from __future__ import annotations

from importlib import import_module

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
MODULES = ["mixing", "simhash", "bpe", "bloom_dedup", "token_counts", "language", "run_index", "divergence", "line_winnowing", "surrogates",
           "bit_clusters", "vector_copies", "prefix_trie"]


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return register


def load() -> None:
    for module in MODULES:
        import_module(f"slipweave.llm.{module}")
