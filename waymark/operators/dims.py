"""Small fixed dimensions as DataFrames or array literals."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark import fixed


def texts(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A fixed table of this package, marked for broadcast (at most a few hundred rows)."""
    # literals of the plan: rows from Python would start Python workers
    values = F.array(*[F.struct(*[F.lit(v) for v in row]) for row in rows]).cast(f"array<struct<{schema}>>")
    return F.broadcast(spark.range(0, 1, 1, 1).select(F.inline(values)))


def level_config(spark: SparkSession) -> DataFrame:
    return table(spark, fixed.LEVEL_CONFIG, fixed.LEVEL_CONFIG_SCHEMA)


def level_order(level: Column) -> Column:
    """Position of a level in report order."""
    return F.coalesce(*[F.when(level == name, F.lit(i)) for i, name in enumerate(fixed.LEVELS)], F.lit(len(fixed.LEVELS)))
