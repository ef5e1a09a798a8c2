"""All core queries and their SQL."""

from __future__ import annotations

from tessella.plans import curation_queries, drift_queries, evidence_queries, reply_queries

MODULES = (drift_queries, evidence_queries, curation_queries, reply_queries)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in MODULES for k, s in m.ORACLE.items()}
