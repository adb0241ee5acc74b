"""All registered queries of the engine."""

from __future__ import annotations

from tessera.plans import aggregate_queries, change_queries, relational_queries, scalar_queries, text_queries  # noqa: F401
from tessera.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
