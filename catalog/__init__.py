"""Registered queries: each a Spark function over the given tables and, where SQL can say it, its oracle."""

from __future__ import annotations

QUERIES = {}
ORACLES = {}


def query(name: str, oracle: str | None = None):
    """Register a function (spark, sf_dir) → DataFrame with its oracle SQL."""
    def register(run):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return run
    return register
