"""Counts, existence, scalar and grouped aggregates: each one partial aggregation and one small shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FUNCTIONS = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("count"))


def exists(df: DataFrame) -> DataFrame:
    """One row; the scan stops at the first hit of each task."""
    return df.select(F.lit(1).alias("one")).limit(1).agg((F.count("one") > 0).alias("exists"))


def aggregate(df: DataFrame, function: str, column: str) -> DataFrame:
    """One row; null if there are no rows."""
    return df.agg(FUNCTIONS[function](column).alias("value"))


def group_count(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("key")).agg(F.count(F.lit(1)).alias("count"))
