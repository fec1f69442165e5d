"""The registered queries over the driver's tables and their SQL twins."""

from __future__ import annotations

from docmill.plans import documents_queries, table_queries

QUERIES: dict = documents_queries.QUERIES | table_queries.QUERIES
ORACLES: dict[str, str] = documents_queries.ORACLES | table_queries.ORACLES
