"""Python values as typed columns."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal
from enum import Enum
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F


def plain(value: Any) -> Any:
    """An enum's value, and an integer beyond 64 signed bits as a decimal; anything else as it is."""
    if isinstance(value, Enum):
        value = value.value
    if isinstance(value, int) and not isinstance(value, bool) and not -(2**63) <= value < 2**63:
        return Decimal(value)
    return value


def literal(value: Any, kind: str) -> SparkColumn:
    """A value as a column of a Spark type; a time without a zone is taken as it is written, whatever the zone of Python."""
    value = plain(value)
    if isinstance(value, datetime) and value.tzinfo is None and kind.startswith("timestamp"):
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz").cast(kind)
    return F.lit(value).cast(kind)


def fitting(value: Any, kind: str) -> Any:
    """A Python value as Spark wants it in a row for a column of ``kind``."""
    value = plain(value)
    if value is None or isinstance(value, bool):
        return value
    if kind.startswith("decimal"):
        return Decimal(str(value))
    return float(value) if kind in ("float", "double") else value
