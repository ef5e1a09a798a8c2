"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from tessella.llm import defect_queries, leak_queries, mixing_queries, neardup_queries, quota_queries, spans_queries, truncation_queries

MODULES = (quota_queries, neardup_queries, defect_queries, leak_queries, mixing_queries, spans_queries, truncation_queries)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in MODULES for k, s in m.ORACLE.items()}
