"""Rows that tables start with, put in by registered functions in their order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators import writes
from .store import Store


class Seeders:
    """Functions of the tables, run by ascending order and, where that is equal, as they were registered; an error ends the run."""

    def __init__(self):
        self._known: list[tuple[int, Callable]] = []

    def register(self, order: int = 0):
        def keep(function: Callable) -> Callable:
            self._known.append((order, function))
            return function

        return keep

    def run(self, tables) -> list[str]:
        """The names of the functions, in the order in which they ran."""
        ran = []
        for _, function in sorted(self._known, key=lambda k: k[0]):
            function(tables)
            ran.append(function.__name__)
        return ran


def seed(store: Store, rows: DataFrame | list[dict]) -> int:
    """Insert those of ``rows`` whose key the table lacks, so that a second run adds nothing; how many they were."""
    keys = [k.name for k in store.entity.keys]
    given = store.as_frame(rows)
    if set(keys) <= set(given.columns):
        writes.one_row_a_key(store.entity, given)
        given = given.join(store.rows().select(*keys), keys, "left_anti")
    return store.insert_frame(given)
