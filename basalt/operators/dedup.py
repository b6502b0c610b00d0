"""Exact deduplication on key columns; all columns of the kept row stay.

Keys are compared as Spark groups them: null equals null, NaN equals NaN, 0.0 equals
-0.0. With ``order_by`` the first row of that order is kept, else any one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..metrics import instrumented
from ..resolve import col, fields, hashable, quoted

_ROW = "__row"


@instrumented
def drop_duplicates(df: DataFrame, columns: Sequence[str], order_by: Sequence[str] | None = None, max_distinct_keys: int | None = None) -> DataFrame:
    """One row for each different key.

    order_by: columns whose least values, nulls first, pick the row; ties of the
    whole order are Spark's choice. The pick is an aggregate with partial results
    before the exchange, so a hot key doesn't gather its rows. max_distinct_keys: a
    MemoryError, before any result, if there are more keys than that.
    """
    keys = hashable(df, columns)
    names = [f.name for f in keys]
    if max_distinct_keys is not None:
        found = df.select(*[col(n) for n in names]).distinct().limit(max_distinct_keys + 1).count()
        if found > max_distinct_keys:
            raise MemoryError(f"more than {max_distinct_keys} distinct keys")
    if not order_by:
        return df.dropDuplicates(names)
    order = F.struct(*[x for f in fields(df, order_by) for x in (col(f.name).isNotNull(), col(f.name))])
    row = F.struct(*[col(n) for n in df.columns])
    picked = df.groupBy(*[quoted(n) for n in names]).agg(F.min_by(row, order).alias(_ROW))
    return picked.select(*[F.col(_ROW)[n].alias(n) for n in df.columns])
