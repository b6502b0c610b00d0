"""Tables in and out: Parquet reading, Arrow schemas and exports, the batch escape hatch."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..metrics import instrumented


def read_tables(spark: SparkSession, folder: str, names: Iterable[str]) -> dict[str, DataFrame]:
    """name -> table of folder/name.parquet; any path that Spark can read."""
    return {n: spark.read.parquet(f"{folder.rstrip('/')}/{n}.parquet") for n in names}


@instrumented
def to_arrow_schema(schema: DataFrame | T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema as convert

    return convert(schema if isinstance(schema, T.StructType) else schema.schema)


@instrumented
def collect_as_record_batch(df: DataFrame) -> pa.RecordBatch:
    """All rows as one batch on the driver, for tables known to be small; the columns of every chunk."""
    table = df.toArrow().combine_chunks()
    batches = table.to_batches()
    return batches[0] if batches else pa.RecordBatch.from_pylist([], table.schema)


@instrumented
def map_in_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """A function over each partition's batches: the only way to run Python code on rows, and a barrier for the optimizer."""
    return df.mapInArrow(function, schema)
