"""Registry of the engine's own queries and their SQL."""

from __future__ import annotations

from sonogrid.plans import queries as plans


def queries() -> dict:
    return dict(plans.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(plans.ORACLES)
