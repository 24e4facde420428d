"""All queries of the subpackage and their SQL."""

from __future__ import annotations

from pointloom.llm import leak_queries, quantile_queries, residue_queries, run_queries, split_queries, token_queries, topn_queries

_MODULES = (topn_queries, quantile_queries, run_queries, split_queries, token_queries, leak_queries, residue_queries)


def queries() -> dict:
    """Queries by name."""
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    return {name: sql for m in _MODULES for name, sql in getattr(m, "SQL", {}).items()}
