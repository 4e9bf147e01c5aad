"""The named queries of the core and the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from evalweave.plans import audits, building, retrieval, scoring, studies
from evalweave.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]
MODULES = [scoring, building, retrieval, audits, studies]


def _shipped(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, d: str) -> DataFrame:
        ship_package(spark)
        return query(spark, d)

    return run


def queries() -> dict[str, Query]:
    return {k: _shipped(f) for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.ORACLE.items()}
