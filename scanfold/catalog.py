"""All registered queries of the library proper and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import member_queries as _members  # noqa: F401  registers its queries
from .plans import queries as registered
from .plans import table_queries as _tables  # noqa: F401  registers its queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logical signatures over all documents."""
    return registered.QUERIES["logical_signatures"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registered.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registered.ORACLES)
