"""All queries and oracles of the engine, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ("metrics", "records", "text", "arcs", "conversations", "boundary", "calls", "curation", "files")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"loomspan.plans.{m}").QUERIES.items()}


def oracles() -> dict:
    return {k: s for m in MODULES for k, s in import_module(f"loomspan.plans.{m}").ORACLES.items()}
