"""Equi-joins on paired key lists, with explicit null semantics.

Both sides keep all columns, keys included; a right column that is named like a left
one gets the suffix ``_right``. By default a null key matches nothing and still comes
out as unmatched; the null-safe forms match null with null, column by column. Rows
come in no order. Nullability is Spark's, which may be tighter than all-nullable.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError, SchemaMismatch, TypeMismatch
from ..metrics import instrumented
from ..resolve import fields, quoted

KINDS = ("inner", "left", "right", "full")
SUFFIX = "_right"
#: Estimated bytes up to which a side is broadcast on request.
BROADCAST_BYTES = 64 * 1024 * 1024


def _renamed(left: DataFrame, right: DataFrame) -> list[str]:
    taken = set(left.columns)
    names = [n + SUFFIX if n in taken else n for n in right.columns]
    out = [*left.columns, *names]
    if len(set(out)) < len(out):
        raise SchemaMismatch(f"result columns repeat: {out}")
    return names


def _joined(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str], how: str, null_safe: bool, prepare=lambda df: df) -> DataFrame:
    if how not in KINDS:
        raise ValueError(f"unknown join type {how!r}; there are {KINDS}")
    if not left_keys or len(left_keys) != len(right_keys):
        raise ConfigError("both key lists must have the same length, one or more")
    for a, b in zip(fields(left, left_keys), fields(right, right_keys), strict=True):
        if a.dataType != b.dataType:
            raise TypeMismatch(f"key {a.name!r} is {a.dataType.simpleString()}, {b.name!r} is {b.dataType.simpleString()}")
    names = _renamed(left, right)
    key_names = [names[right.columns.index(k)] for k in right_keys]
    # A new name for every right column on its own, so that a table can be joined with itself.
    right = prepare(right.toDF(*names))
    on = [(left[quoted(a)], right[quoted(b)]) for a, b in zip(left_keys, key_names, strict=True)]
    condition = reduce(lambda x, y: x & y, [a.eqNullSafe(b) if null_safe else a == b for a, b in on])
    return left.join(right, condition, how)


@instrumented
def join(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Rows whose keys are equal and not null; how: inner, left, right or full."""
    return _joined(left, right, left_keys, right_keys, how, False)


@instrumented
def join_null_safe(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Rows whose keys are equal, null counting as equal to null."""
    return _joined(left, right, left_keys, right_keys, how, True)


def estimated_bytes(df: DataFrame) -> int | None:
    """The optimizer's estimate of a table's size, where the session tells it."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except AttributeError:  # a remote session
        return None


@instrumented
def broadcast_join(df: DataFrame, small: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str], how: str = "inner", max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """An inner or left join that sends ``small`` to every executor, if its estimated size allows it.

    Beyond max_bytes it is an ordinary join, and Spark picks the strategy.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"a broadcast join is inner or left, not {how!r}")
    size = estimated_bytes(small)
    fits = size is not None and size <= max_bytes
    return _joined(df, small, left_keys, right_keys, how, False, F.broadcast if fits else lambda x: x)
