"""All queries outside the llm subpackage, and their DuckDB SQL."""

from __future__ import annotations

from . import catalog_codings, catalog_cohort, catalog_grounding, catalog_hierarchy, catalog_lookup, catalog_notes, catalog_search, catalog_text

MODULES = (catalog_hierarchy, catalog_cohort, catalog_search, catalog_codings, catalog_grounding, catalog_notes, catalog_text, catalog_lookup)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
