"""Registered queries over the driver's tables, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from importlib import import_module

MODULES = ["mining", "text", "search", "stances", "prompts", "tables", "streams", "files"]


def _merged(name: str) -> dict:
    merged: dict = {}
    for module in MODULES:
        part = getattr(import_module(f"catalog.{module}"), name)
        twice = merged.keys() & part.keys()
        if twice:
            raise ValueError(f"registered twice: {sorted(twice)}")
        merged.update(part)
    return merged


def all_queries() -> dict:
    return _merged("QUERIES")


def all_oracles() -> dict:
    return _merged("ORACLE")
