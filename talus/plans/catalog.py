"""The registered queries and, where SQL can express them, their oracles."""

from __future__ import annotations

from talus.plans import corpus, events, modules, packages, registry, risk, service, sources, trust

MODULES = (risk, events, corpus, packages, modules, sources, registry, trust, service)


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
