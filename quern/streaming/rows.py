"""Rows of a result one after another, a partition in memory at a time."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row


def stream_rows(df: DataFrame, prefetch: bool = True) -> Iterator[Row]:
    """Rows in order, however many: the driver holds one partition, or two with ``prefetch``."""
    return df.toLocalIterator(prefetchPartitions=prefetch)
