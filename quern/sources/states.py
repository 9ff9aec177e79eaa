"""Tables that change: a change makes the table's next state out of the one before, by plain DataFrame writes.

There are no transactions, locks or logs here: who needs several writers at once takes a table format that has them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import StoreError
from .entity import Entity
from .shared import drop_folder
from .tables import declared

#: Marks rows that a change touches.
FLAG = "__hit"


class StateTables:
    """Tables as ``source`` (any tables) has them, until a store changes them.

    Without a folder a change is a plan over the state before it, and the number of touched rows a job of its own. With one,
    each change writes ``folder/<table>/<number>``, reading the state before it once: touched rows are counted on the way. The
    highest finished number is the current state; inserts add files to it and copy nothing (the first change of a table that
    ``source`` has writes it whole). Older states stay until they are deleted by hand. A change that touches no row changes
    nothing. One writer at a time.
    """

    def __init__(self, spark: SparkSession, source=None, folder: str | None = None):
        self.spark, self.source, self.folder = spark, source, folder.rstrip("/") if folder else None
        self._plans: dict[str, DataFrame] = {}

    # states

    def _numbers(self, entity: type[Entity]) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{entity.table}/*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        names = [s.getPath().getParent().getName() for s in found or []]
        return sorted(int(n) for n in names if n.isdigit())

    def _state(self, entity: type[Entity]) -> tuple[DataFrame, str | None]:
        """The stored rows, and the folder that they lie in if a change has written them."""
        if entity.table in self._plans:
            return self._plans[entity.table], None
        numbers = self._numbers(entity) if self.folder else []
        if numbers:
            path = f"{self.folder}/{entity.table}/{numbers[-1]:09d}"
            schema = ", ".join(f"`{c.name}` {c.spark_type}" for c in entity.columns.values())
            return self.spark.read.schema(schema).parquet(path), path
        if self.source is None:
            raise StoreError(f"no table {entity.table}")
        return self.source.frame(entity), None

    def frame(self, entity: type[Entity]) -> DataFrame:
        return declared(self._state(entity)[0], entity)

    def create(self, entity: type[Entity], rows: DataFrame) -> None:
        """Make the table from ``rows``, in place of what it held."""
        rows = _typed(entity, rows)
        if self.folder:
            rows.write.mode("overwrite").parquet(self._next(entity))
        else:
            self._plans[entity.table] = rows

    def _next(self, entity: type[Entity]) -> str:
        """Where the next state goes; what a failed write has left there is overwritten."""
        return f"{self.folder}/{entity.table}/{max(self._numbers(entity), default=0) + 1:09d}"

    # changes

    def append(self, entity: type[Entity], rows: DataFrame, checked: Callable[[DataFrame], None], returning: bool = False) -> int | Row | None:
        """Add rows unless ``checked`` raises; their number, or the first one as stored.

        With a folder the rows are written aside first, so what is checked, numbered, stored and returned is the same, however
        the rows were made; the table's own files are not read but for their keys.
        """
        rows = _typed(entity, rows)
        if not self.folder:
            if any(k.generated or k.sequential_guid for k in entity.columns.values()):
                raise StoreError(f"{entity.__name__} has keys that are made; they need tables with a folder")
            checked(rows)
            self._plans[entity.table] = _typed(entity, self._state(entity)[0]).unionByName(rows)
            return rows.first() if returning else rows.count()
        aside = f"{self.folder}/.aside/{uuid.uuid4().hex}"
        seen = Observation()
        try:
            rows.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(aside)
            if not seen.get["n"]:
                return None if returning else 0
            kept = self.spark.read.schema(rows.schema).parquet(aside)
            made = next((k.name for k in entity.keys if k.generated), None)
            if made:
                kept = self._numbered(entity, kept, made)
            checked(kept)
            state, path = self._state(entity)
            if path:
                kept.write.mode("append").parquet(path)
            else:
                _typed(entity, state).unionByName(kept).write.mode("overwrite").parquet(self._next(entity))
            return kept.first() if returning else seen.get["n"]
        finally:
            drop_folder(self.spark, aside)

    def _numbered(self, entity: type[Entity], rows: DataFrame, key: str) -> DataFrame:
        """Keys after the highest for rows without one, by the place of the row in its file: the same at every evaluation."""
        first = (self.frame(entity).agg(F.max(key)).first()[0] or 0) + 1
        placed = rows.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
        before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
        starts = placed.groupBy("__file").agg(F.count("*").alias("n")).select("__file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
        own = (F.lit(first) + F.col("__start") + F.col("__row")).cast(rows.schema[key].dataType)
        return placed.join(starts, "__file").withColumn(key, F.coalesce(F.col(key), own)).select(*rows.columns)

    def replace(self, entity: type[Entity], marked: DataFrame, finish: Callable[[DataFrame], DataFrame]) -> int:
        """The next state is ``finish`` of ``marked``, the state with FLAG on the rows that are touched; their number."""
        touched = F.count(F.when(F.col(FLAG), 1)).alias("n")
        if not self.folder:
            n = marked.agg(touched).first()[0]
            if n:
                self._plans[entity.table] = _typed(entity, finish(marked))
            return n
        seen, path = Observation(), self._next(entity)
        _typed(entity, finish(marked.observe(seen, touched))).write.mode("overwrite").parquet(path)
        n = seen.get["n"]
        if not n:
            drop_folder(self.spark, path)
        return n


def _typed(entity: type[Entity], rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(c.name).cast(c.spark_type).alias(c.name) for c in entity.columns.values()])
