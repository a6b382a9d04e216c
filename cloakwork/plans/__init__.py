"""Session settings, size checks, and the registered queries with their check SQL."""

from __future__ import annotations

import importlib

#: Modules that register queries when imported.
QUERY_MODULES = ("detection", "policy", "audit", "reports", "retrieval", "changes", "streams")


def load_queries() -> dict:
    """All registered queries by name."""
    from .registry import QUERIES

    for name in QUERY_MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return QUERIES


def run(name: str, spark, sf_dir: str):
    """Build the DataFrame of one registered query."""
    load_queries()
    from .registry import run as build

    return build(name, spark, sf_dir)
