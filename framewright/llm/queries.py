"""Queries and SQL of the problems in this folder."""

from __future__ import annotations

from framewright.llm import p1_neighbors, p2_components, p3_runs, p4_pairs, p6_tokens, p7_leaks, p8_pii

_MODULES = (p1_neighbors, p2_components, p3_runs, p4_pairs, p6_tokens, p7_leaks, p8_pii)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
