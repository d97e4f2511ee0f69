"""The registry of named queries and their DuckDB twins, from the modules that hold them."""

from __future__ import annotations

from tidewright.plans import event_queries, group_queries, ledger_queries, payload_queries, release_queries, report_queries, scalar_queries, seed_queries, source_queries, table_queries

MODULES = (event_queries, table_queries, payload_queries, seed_queries, ledger_queries, group_queries, release_queries, report_queries, scalar_queries, source_queries)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
