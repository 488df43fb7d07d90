"""All registered graph queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattica.plans import access, aggregates, indexes, joins, modules, more, projects, questions, registry, reports, scalars, surface, traversal, truths

FAMILIES = (traversal, aggregates, joins, scalars, reports, more, surface, access, projects, modules, questions, indexes, truths)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLE)
