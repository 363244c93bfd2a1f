"""Queries over the driver's tables, and DuckDB's SQL for the same."""

from __future__ import annotations

from tessera.plans import clusters, files, filings, prices, text

_parts = (prices, filings, text, clusters, files)
QUERIES: dict = {k: v for p in _parts for k, v in p.QUERIES.items()}
SQL: dict = {k: v for p in _parts for k, v in p.SQL.items()}
