"""All queries of the core and their SQL."""

from __future__ import annotations

from lodestrata.plans import analytics, history, integrity, scalars, stream

MODULES = [scalars, analytics, history, integrity, stream]

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
