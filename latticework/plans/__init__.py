"""Adapters from the star-schema tables, and the registered queries."""

from . import collected, enriched, expanded, queries, reports, scoped, stateful

__all__ = ["collected", "enriched", "expanded", "queries", "reports", "scoped", "stateful"]
