"""All queries but those of the training-text subpackage."""

from __future__ import annotations

from importlib import import_module

from cairn.plans.registry import ORACLE, QUERIES

for _name in ("basics", "searches", "ingest", "matching", "routing", "streams"):
    import_module(f"cairn.plans.{_name}")

__all__ = ["ORACLE", "QUERIES"]
