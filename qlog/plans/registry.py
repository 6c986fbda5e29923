"""All queries of the engine's own operators and their SQL twins."""

from __future__ import annotations

from qlog.plans import q_baseline, q_facts, q_operations, q_records, q_search

MODULES = [q_baseline, q_facts, q_search, q_records, q_operations]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in MODULES for name, s in m.SQL.items()}
