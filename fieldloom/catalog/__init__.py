"""Registered queries: every operator on the given tables, with comparison SQL."""

from __future__ import annotations

from importlib import import_module

SECTIONS = ["sources", "pages", "tables", "extraction", "keys", "retrieval", "validation", "fields", "registry", "incremental"]


def _merged(what: str) -> dict:
    out: dict = {}
    for section in SECTIONS:
        part = getattr(import_module(f"fieldloom.catalog.{section}"), what)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(part)
    return out


def all_queries() -> dict:
    return _merged("QUERIES")


def all_oracles() -> dict:
    return _merged("ORACLES")
