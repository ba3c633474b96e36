"""Registry of the engine's queries and of the SQL that they are checked against."""

from __future__ import annotations

from .deploy import shipped
from .plans import clusters, decisions, editions, history, records, relational, rules, shares, storage, texts, units  # noqa: F401  (they register queries)
from .plans.registry import QUERIES, SQL
from .streaming import plans as _streaming  # noqa: F401


def queries() -> dict:
    return {name: shipped(f) for name, f in QUERIES.items()}


def oracle_sql() -> dict:
    return dict(SQL)
