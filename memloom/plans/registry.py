"""All queries of the core by name, and the SQL that gives the same rows."""

from __future__ import annotations

from memloom.operators import history, timestamps
from memloom.plans import graph, ingest, kg, relational, search, streams, text, times_sql

_MODULES = (relational, search, kg, graph, text, ingest, streams)

QUERIES = {
    "p2_found": history.p2_found,
    "p2_history": history.p2_history,
    "p3_found": timestamps.p3_found,
}
SQL: dict[str, str] = {"p2_found": times_sql.P2, "p3_found": times_sql.P3}
for _m in _MODULES:
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
