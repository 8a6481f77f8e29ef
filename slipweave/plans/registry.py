"""Registry of the named queries and of the SQL each one is checked against."""
from __future__ import annotations

from slipweave.sources.feeds import slip_feed_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query. In the SQL ``@FEED`` stands for the slip feed subquery."""
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle.replace("@FEED", f"({slip_feed_sql('duckdb')})")
        return fn
    return register
