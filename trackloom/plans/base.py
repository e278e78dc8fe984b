"""The query registry: functions by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.plans.adapters import oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def query(sql: str | None = None, views: str = ""):
    """Register a query under its function's name, with its oracle over views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = oracle(sql, *views.split())
        return f

    return add


def round_to(value: Column, digits: int = DIGITS) -> Column:
    """round() of the oracle SQL: the scaled value goes to the nearest integer, ties away from zero. Spark's own
    rounds the shortest decimal text instead, which differs where the product is just off a tie."""
    scale = float(10**digits)
    return F.when(F.abs(value) < 1e300, F.round(value * scale) / scale).otherwise(value)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(round_to(F.col(c)).alias(c) if t == "double" else F.round(c, DIGITS).alias(c) if t == "float" else F.col(c) for c, t in df.dtypes))


def cols(*names: str) -> tuple[Column, ...]:
    return tuple(F.col(n) for n in names)
