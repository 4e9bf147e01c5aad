"""Parquet tables: reading by name, columns that may be absent, one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """``{sf_dir}/{name}.parquet``, pruned to ``columns`` where given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def with_missing_as_null(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to ``schema``: a column that ``df`` lacks was never annotated and becomes NULL."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def first_per_key(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """One row per key, the first by ``order`` with ``columns`` as tie-break: an aggregate, so it combines map-side.

    A NULL in ``order`` sorts first. Complex columns ride along and must be orderable (arrays and structs are).
    """
    ranked = F.min(F.struct(*order, *columns)).alias("_r")
    return df.groupBy(*keys).agg(ranked).select(*keys, *[F.col(f"_r.`{c}`").alias(c) for c in columns])


def join_nullsafe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined to ``right``'s other columns on ``keys``, where NULL equals NULL."""
    named = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(named, cond, how).drop(*[f"_r_{k}" for k in keys])


def head(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows by ``order``: the same rows on every read, unlike a bare limit."""
    return df.orderBy(*order).limit(n)
