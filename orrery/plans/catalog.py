"""All queries of the library outside orrery.llm, and their oracle SQL."""

from __future__ import annotations

from orrery.plans import analytics, filters, graphs, ingest, retrieval

_PARTS = (retrieval, filters, graphs, analytics, ingest)
QUERIES = {name: f for p in _PARTS for name, f in p.QUERIES.items()}
SQL = {name: s for p in _PARTS for name, s in p.SQL.items()}
