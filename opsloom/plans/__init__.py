"""End-to-end plans and the catalogue of runnable queries."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["queries_text", "queries_search", "queries_chat", "queries_ops", "queries_stored"]


def all_queries():
    """Names to queries, and names to their SQL twins."""
    from opsloom.plans import catalog

    for name in _MODULES:
        import_module(f"opsloom.plans.{name}")
    return catalog.QUERIES, catalog.ORACLES
