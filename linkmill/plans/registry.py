"""All queries of the entity-resolution engine, by name, and their SQL."""

from __future__ import annotations

from linkmill.plans import pair_queries, record_queries  # noqa: F401  they register their queries
from linkmill.plans.fixtures import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
