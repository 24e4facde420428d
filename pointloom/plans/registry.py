"""All queries of the core and their SQL."""

from __future__ import annotations

from pointloom.plans import card_queries, cluster_queries, file_queries, nested_queries, point_queries, relational_queries

_MODULES = (relational_queries, point_queries, card_queries, cluster_queries, nested_queries, file_queries)

FLAGSHIP = point_queries.kmeans_lloyd


def queries() -> dict:
    """Queries by name."""
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    return {name: sql for m in _MODULES for name, sql in getattr(m, "SQL", {}).items()}
