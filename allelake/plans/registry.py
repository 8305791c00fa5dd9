"""All queries of the core, by name."""

from __future__ import annotations

from allelake.plans import files, headers, skewed, spans, store, variants, wide

MODULES = (variants, store, files, skewed, headers, wide, spans)


def queries() -> dict:
    """Name to callable (spark, folder) -> DataFrame."""
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Name to SQL."""
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
