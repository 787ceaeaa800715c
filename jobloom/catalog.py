"""Registered queries of the planning operators and their SQL."""

from __future__ import annotations

from jobloom.operators import expressions, extras, more, naming, relational, verify  # noqa: F401  registers
from jobloom.plans import queries as plan_queries  # noqa: F401  registers
from jobloom.registry import QUERIES, SQL, Query
from jobloom.sources import queries as source_queries  # noqa: F401  registers
from jobloom.sources import synthetic  # noqa: F401  registers
from jobloom.streaming import queries as stream_queries  # noqa: F401  registers


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
