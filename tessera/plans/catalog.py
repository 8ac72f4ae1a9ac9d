"""Catalogue of the engine's queries: name -> Spark query, and name -> DuckDB oracle."""

from __future__ import annotations

from tessera.plans import aggregates, dependencies, dispatching, extras, filequeries, joins, packing, retrieval, scoring, texts, vectors, windows  # noqa: F401  each registers its queries
from tessera.plans.base import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
