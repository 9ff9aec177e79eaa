"""Identifiers that grow with time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sequential_guid() -> Column:
    """A version-7 UUID: milliseconds since 1970 first, then random bits."""
    stamp = F.lpad(F.lower(F.hex(F.unix_millis(F.current_timestamp()))), 12, "0")
    noise = F.replace(F.uuid(), F.lit("-"), F.lit(""))
    return F.concat(F.substring(stamp, 1, 8), F.lit("-"), F.substring(stamp, 9, 4), F.lit("-7"), F.substring(noise, 14, 3), F.lit("-"), F.lit("8"), F.substring(noise, 18, 3), F.lit("-"), F.substring(noise, 21, 12))
