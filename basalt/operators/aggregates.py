"""Grouped and whole-table aggregation with exact results.

Sums of integers are exact and checked once, at the end; decimals keep their type,
and their mean is truncated toward zero at its scale. Nulls are left out of every
function; a group of nulls has count 0 and null for the rest. Group keys are
Spark's: null equals null, NaN equals NaN, 0.0 equals -0.0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import UnsupportedType
from ..metrics import instrumented
from ..resolve import col, field, fields, quoted, require_conf

FUNCTIONS = ("count", "sum", "mean", "avg", "min", "max")
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: Bits of the two lower limbs of an exact sum of longs: each limb sums over 2^41 rows.
_LOW, _MIDDLE = 22, 21


def exact_sum(c: Column, dtype: T.DataType) -> Column:
    """The sum of integers as decimal(38,0), whatever its size.

    A long is summed in three limbs of at most 22 bits, so the hot loop adds longs
    in generated code and only the result is a decimal.
    """
    if not isinstance(dtype, T.LongType):
        return F.sum(c).cast("decimal(38,0)")
    low, middle = (1 << _LOW) - 1, (1 << _MIDDLE) - 1
    limbs = (
        (F.shiftright(c, _LOW + _MIDDLE), 1 << (_LOW + _MIDDLE)),
        (F.shiftright(c, _LOW).bitwiseAND(F.lit(middle)), 1 << _LOW),
        (c.bitwiseAND(F.lit(low)), 1),
    )
    total = None
    for limb, weight in limbs:
        part = F.sum(limb).cast("decimal(20,0)") * F.lit(weight).cast("decimal(14,0)")
        total = part if total is None else total + part
    return total.cast("decimal(38,0)")


def _sum(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, _INTEGERS):
        return exact_sum(c, dtype).cast("bigint")
    # A decimal's sum keeps its type, and overflows rather than widen it.
    return F.sum(c).cast(dtype) if isinstance(dtype, T.DecimalType) else F.sum(c.cast("double"))


def _mean(c: Column, dtype: T.DataType) -> Column:
    n = F.count(c)
    if isinstance(dtype, _INTEGERS):
        return F.when(n > 0, exact_sum(c, dtype).cast("double") / n)
    if not isinstance(dtype, T.DecimalType):
        return F.when(n > 0, F.sum(c.cast("double")) / n)
    # Integer division of the unscaled sum truncates toward zero.
    scale = dtype.scale
    digits = min(38, dtype.precision + 10)
    unscaled = (F.sum(c).cast(T.DecimalType(digits, scale)) * F.lit(10**scale).cast(T.DecimalType(scale + 1, 0))).cast("decimal(38,0)")
    count = n.cast("decimal(20,0)")
    quotient = ((unscaled - unscaled % count) / count).cast(T.DecimalType(38 - scale, 0))
    scaled = quotient / F.lit(10**scale).cast(T.DecimalType(scale + 1, 0)) if scale else quotient
    return F.when(n > 0, scaled.cast(dtype))


def _expression(df: DataFrame, column: str, function: str) -> Column:
    dtype = field(df, column).dataType
    c = col(column)
    if function == "count":
        return F.count(c)
    if not isinstance(dtype, T.NumericType):
        raise UnsupportedType(f"{function} of column {column!r}: {dtype.simpleString()}")
    if function == "sum":
        return _sum(c, dtype)
    if function in ("mean", "avg"):
        return _mean(c, dtype)
    return F.min(c) if function == "min" else F.max(c)


@instrumented
def aggregate(df: DataFrame, group_by: Sequence[str], aggregations: Sequence[tuple[str, str, str]]) -> DataFrame:
    """The group columns, then one column for each (column, function, alias).

    An empty group_by makes one group of the whole table, with a row even if that is
    empty. Functions: count, sum, mean or avg, min, max.
    """
    if not aggregations:
        raise ValueError("no aggregations given")
    names = [f.name for f in fields(df, group_by)]
    for _, function, _ in aggregations:
        if function not in FUNCTIONS:
            raise ValueError(f"unknown aggregate function {function!r}; there are {FUNCTIONS}")
    out = [*names, *[alias for *_, alias in aggregations]]
    if len(set(out)) < len(out):
        raise ValueError(f"result columns repeat: {out}")
    require_conf(df, "spark.sql.ansi.enabled", "true")
    made = [_expression(df, column, function).alias(alias) for column, function, alias in aggregations]
    return df.groupBy(*[quoted(n) for n in names]).agg(*made) if names else df.agg(*made)
