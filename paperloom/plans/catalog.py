"""All registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from . import assembly, extraction, facts, ingest, inventory, naming, planning, preview, reports, streams

_MODULES = (inventory, extraction, planning, reports, ingest, naming, streams, facts, assembly, preview)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
