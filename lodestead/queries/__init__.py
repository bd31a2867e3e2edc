"""Named queries over the shared test tables, each with its SQL twin."""

from __future__ import annotations

from importlib import import_module

from lodestead.queries.registry import ORACLES, QUERIES

for _module in ("scoring", "geography", "extraction", "maintenance", "edits", "pricing"):
    import_module(f"lodestead.queries.{_module}")

__all__ = ["ORACLES", "QUERIES"]
