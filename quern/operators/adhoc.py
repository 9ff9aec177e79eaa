"""Hand-written SQL with bound parameters, and procedures by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..errors import StoreError
from ..functions.values import plain
from ..sources.entity import AdHoc


def query(spark: SparkSession, sql: str, shape: type[AdHoc] | None = None, frames: dict[str, DataFrame] | None = None, **parameters) -> DataFrame:
    """``sql`` with ``:name`` parameters bound, never spliced; ``shape`` names the result's columns by position.

    Enums are bound by their value, integers beyond 64 signed bits as decimals. ``frames`` are tables that the text names as
    ``{name}``.
    """
    bound = {k: plain(v) for k, v in parameters.items()}
    df = spark.sql(sql, args=bound or None, **(frames or {}))
    if shape is None:
        return df
    if len(df.columns) != len(shape.fields):
        raise StoreError(f"{shape.__name__} names {len(shape.fields)} columns, the result has {len(df.columns)}")
    return df.toDF(*shape.fields)


def single_or_none(df: DataFrame):
    """The only row, or None; several are an error."""
    rows = df.limit(2).collect()
    if len(rows) > 1:
        raise StoreError("more than one row")
    return rows[0] if rows else None


def scalar(df: DataFrame, default: Any = None) -> Any:
    """The first column of the first row; ``default`` if there is none or it is null."""
    row = df.first()
    return default if row is None or row[0] is None else row[0]


def several(spark: SparkSession, *statements: str, **parameters) -> tuple[DataFrame, ...]:
    """A frame for each statement, in order."""
    return tuple(query(spark, s, **{k: v for k, v in parameters.items() if f":{k}" in s}) for s in statements)


@dataclass(frozen=True)
class Outcome:
    """What a procedure gives: result sets in order, the values of its outputs, and its return value."""

    frames: tuple[DataFrame, ...] = ()
    outputs: dict[str, Any] = field(default_factory=dict)
    returned: Any = None


class Procedures:
    """Named functions of a session and arguments that return a frame, a value, a tuple of them or an ``Outcome``.

    Arguments may be frames (table parameters). A procedure with declared ``outputs`` sets each of them in its outcome;
    those that also are arguments go in and out.
    """

    def __init__(self):
        self._known: dict[str, tuple[Callable, tuple[str, ...]]] = {}

    def register(self, name: str, outputs: tuple[str, ...] = ()):
        def keep(function: Callable) -> Callable:
            if name.lower() in self._known:
                raise StoreError(f"procedure {name} is registered already")
            self._known[name.lower()] = function, tuple(outputs)
            return function

        return keep

    def call(self, spark: SparkSession, name: str, **arguments):
        if name.lower() not in self._known:
            raise StoreError(f"no procedure {name}")
        function, outputs = self._known[name.lower()]
        result = function(spark, **{k: v if isinstance(v, DataFrame) else plain(v) for k, v in arguments.items()})
        if outputs and (not isinstance(result, Outcome) or set(result.outputs) != set(outputs)):
            raise StoreError(f"procedure {name} must set {', '.join(outputs)}")
        return result
