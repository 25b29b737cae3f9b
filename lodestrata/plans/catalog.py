"""The registered queries of the library's own operators, with their DuckDB oracles."""

from __future__ import annotations

from lodestrata.plans import cloud_queries, telemetry_queries

QUERIES: dict = {**cloud_queries.Q, **telemetry_queries.Q}
ORACLES: dict[str, str] = {**cloud_queries.O, **telemetry_queries.O}
