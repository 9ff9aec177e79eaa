"""What the operators of this subpackage share: table access, the shared folder, batching of Arrow data."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import drop_folder, shared_dir

#: Texts handled together inside a task; bounds the memory of a Python worker whatever the size of Arrow's batches.
SLICE_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_scratch: list[list[tuple[SparkSession, str]]] = []


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Tables written in this block, unless to be kept, are deleted at its end; kept ones belong to a block around it."""
    _scratch.append([])
    try:
        yield
    finally:
        for spark, path in _scratch.pop():
            drop_folder(spark, path)


def written(df: DataFrame, tag: str, compression: str = "zstd", keep: int = 0) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts the lineage, and survives lost executors.

    Such a table stays until the ``scratch`` block that it is written in ends, or that many blocks further out.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern/{tag}-{uuid.uuid4().hex}"
    holders = _scratch[: max(0, len(_scratch) - keep)]
    if holders:
        holders[-1].append((spark, path))
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Just the key and the text (null: empty); other columns, whatever their names, are left out."""
    return docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def map_texts(df: DataFrame, rows_of: Callable[[list[list]], list[tuple]], schema: str, *columns: str) -> DataFrame:
    """Apply ``rows_of`` to slices of ``columns``; it gets one list for each column and returns rows of ``schema``.

    Slices hold about SLICE_CHARS characters of the last column, so a worker's memory does not follow the batch size.
    """
    import pyarrow as pa
    import pyarrow.compute
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, start, held = batch.num_rows, 0, 0
            sizes = pyarrow.compute.binary_length(batch.column(batch.num_columns - 1)).to_pylist()
            for i in range(n):
                held += sizes[i] or 0
                if held >= SLICE_CHARS or i == n - 1:
                    part = batch.slice(start, i + 1 - start)
                    rows = rows_of([c.to_pylist() for c in part.columns])
                    if rows:
                        cols = list(zip(*rows))
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, out)], schema=out)
                    start, held = i + 1, 0

    return df.select(*columns).mapInArrow(run, schema)


def map_rows(df: DataFrame, rows_of, schema: str) -> DataFrame:
    """``rows_of`` applied to the lists of all columns, a thousand rows at a time."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                rows = rows_of([c.to_pylist() for c in batch.slice(i, 1000).columns])
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), out)], schema=out)

    return df.mapInArrow(run, schema)
