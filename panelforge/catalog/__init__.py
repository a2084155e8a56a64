"""Queries of the panel operators and their SQL, by name."""

from __future__ import annotations

from panelforge.catalog import clusters, eda, features, forecasting, panels  # noqa: F401  they register their queries
from panelforge.catalog.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
