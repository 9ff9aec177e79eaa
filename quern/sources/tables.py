"""Where an entity's rows come from: Parquet files, frames or a catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StoreError
from .entity import Entity


def declared(df: DataFrame, entity: type[Entity]) -> DataFrame:
    """Exactly the entity's columns, computed ones by their expression; whatever else the table holds is never read."""
    have = set(df.columns)
    return df.select(*[F.expr(c.computed).alias(c.name) if c.computed and c.name not in have else F.col(c.name) for c in entity.columns.values()])


class ParquetTables:
    """One Parquet table for each entity, as ``root/<table>.parquet``; read-only."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def frame(self, entity: type[Entity]) -> DataFrame:
        return declared(self.spark.read.parquet(f"{self.root}/{entity.table}.parquet"), entity)


class FrameTables:
    """Frames by table name; read-only."""

    def __init__(self, spark: SparkSession, frames: dict[str, DataFrame]):
        self.spark, self.frames = spark, frames

    def frame(self, entity: type[Entity]) -> DataFrame:
        if entity.table not in self.frames:
            raise StoreError(f"no frame for {entity.table}")
        return declared(self.frames[entity.table], entity)


class CatalogTables:
    """Tables and views of the session's catalogue; read-only."""

    def __init__(self, spark: SparkSession, database: str | None = None):
        self.spark, self.database = spark, database

    def frame(self, entity: type[Entity]) -> DataFrame:
        name = f"{self.database}.{entity.table}" if self.database else entity.table
        return declared(self.spark.table(name), entity)
