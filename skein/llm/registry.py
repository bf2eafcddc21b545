"""All queries of the training-data operators and their SQL twins."""

from __future__ import annotations

import importlib
from functools import cache
from pathlib import Path


@cache
def load() -> tuple[dict, dict]:
    """(queries, SQL twins) of all ``*_queries`` modules of this subpackage."""
    queries, twins = {}, {}
    for file in sorted(Path(__file__).parent.glob("*_queries.py")):
        module = importlib.import_module(f"skein.llm.{file.stem}")
        queries |= module.QUERIES
        twins |= getattr(module, "ORACLES", {})
    return queries, twins
