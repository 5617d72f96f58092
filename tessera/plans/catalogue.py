"""All named queries of the engine, with their SQL."""

from __future__ import annotations

from tessera.plans import loop_queries, queries, record_queries, state_queries  # noqa: F401

QUERIES, ORACLES = queries.QUERIES, queries.ORACLES
