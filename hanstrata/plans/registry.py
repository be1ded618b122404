"""All queries of the library's core, and their SQL."""

from __future__ import annotations

from hanstrata.plans import key_queries, stage_queries

MODULES = [key_queries, stage_queries]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in MODULES for k, s in m.ORACLE.items()}
