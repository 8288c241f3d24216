"""Registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

MODULES = ["queries_mixing", "queries_vectors", "queries_text", "queries_secrets", "queries_repair", "queries_phrases"]


def _merged(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(import_module(f"disputatio.llm.{module}"), name)
    return out


def all_queries() -> dict:
    return _merged("QUERIES")


def all_oracles() -> dict:
    return _merged("ORACLE")
