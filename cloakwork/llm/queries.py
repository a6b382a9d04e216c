"""The registered queries of this subpackage."""

from __future__ import annotations

import importlib

from .common import QUERIES

MODULES = ("language_id", "jaccard_join", "toxicity", "exact_search", "simhash", "bpe", "secrets", "packing", "html_text", "url_filter", "token_counts", "spelling", "alignment")


def load() -> dict:
    """name → (builder, check SQL or None)."""
    for name in MODULES:
        importlib.import_module(f"{__package__}.{name}")
    return QUERIES
