"""All queries and their check SQL by operator id."""

from __future__ import annotations

from plumbline.plans import (
    queries_classify,
    queries_govern,
    queries_history,
    queries_ingest,
    queries_verify,
    queries_warehouse,
)

MODULES = (
    queries_ingest,
    queries_history,
    queries_classify,
    queries_warehouse,
    queries_verify,
    queries_govern,
)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
