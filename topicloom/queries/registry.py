"""All named queries and their SQL counterparts."""

from __future__ import annotations

from importlib import import_module

_MODULES = [
    "text_queries", "analytics_queries", "term_queries", "search_queries", "cluster_queries", "job_queries", "io_queries",
    "representation_queries", "fact_queries",
]


def _gather(attribute: str) -> dict:
    found: dict = {}
    for name in _MODULES:
        entries = getattr(import_module(f"topicloom.queries.{name}"), attribute)
        clash = found.keys() & entries.keys()
        if clash:
            raise ValueError(f"duplicate query names: {sorted(clash)}")
        found.update(entries)
    return found


def all_queries() -> dict:
    return _gather("QUERIES")


def all_oracles() -> dict:
    return _gather("ORACLES")
