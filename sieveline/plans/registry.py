"""Queries over the test tables, one per operator, with SQL that checks them."""

from __future__ import annotations

from sieveline.plans import curation, evaluation, grouping, reports, splits  # noqa: F401  they fill the catalog
from sieveline.plans.catalog import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
