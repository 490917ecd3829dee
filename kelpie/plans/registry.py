"""Named queries and the SQL that must agree with them."""

from __future__ import annotations

from kelpie.plans import more  # noqa: F401  registers its queries
from kelpie.plans.queries import ORACLE, QUERIES


def queries():
    """Every query of this package by name."""
    return dict(QUERIES)


def oracle_sql():
    """DuckDB SQL of the queries that SQL can express."""
    return dict(ORACLE)
