"""Queries of the engine by name, and the SQL that checks them."""

from __future__ import annotations

from .plans import attribution, contrasts, feeds, hours, live, live_evidence, measures, relational, studies, timeseries  # noqa: F401  they register their queries
from .plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
