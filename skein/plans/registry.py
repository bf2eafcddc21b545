"""All queries of the core and their SQL twins."""

from __future__ import annotations

import importlib
from functools import cache

MODULES = ("hierarchy_queries", "cloud_queries", "discussion_queries", "series_queries", "stats_queries")


@cache
def load() -> tuple[dict, dict]:
    """(queries, SQL twins) of all plan modules."""
    queries, twins = {}, {}
    for name in MODULES:
        module = importlib.import_module(f"skein.plans.{name}")
        queries |= module.QUERIES
        twins |= module.ORACLES
    return queries, twins
