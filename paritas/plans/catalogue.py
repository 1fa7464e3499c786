"""The registered queries of the audit engine, with their SQL."""

from __future__ import annotations

from paritas.plans import audit_queries, baseline_queries, evidence_queries, interval_queries, lineage_queries, quality_queries, signal_queries

_ALL = audit_queries.QUERIES | evidence_queries.QUERIES | signal_queries.QUERIES | lineage_queries.QUERIES | interval_queries.QUERIES | quality_queries.QUERIES | baseline_queries.QUERIES


def queries() -> dict:
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
