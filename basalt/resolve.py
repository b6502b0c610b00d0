"""Case-sensitive names and eager type checks on a DataFrame's schema."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import ConfigError, SchemaMismatch, UnknownColumn, UnsupportedType

#: Types with a row hash; also those of dedup keys and equivalence.
HASHABLE = (
    T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.StringType,
    T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType, *([T.TimeType] if hasattr(T, "TimeType") else []),
)


def quoted(name: str) -> str:
    """A name as one identifier, dots and backquotes included."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def field(df: DataFrame, name: str) -> T.StructField:
    """The field of exactly this name."""
    found = [f for f in df.schema.fields if f.name == name]
    if not found:
        raise UnknownColumn(f"no column {name!r}; there are {df.columns}")
    if len(found) > 1:
        raise SchemaMismatch(f"{len(found)} columns are named {name!r}")
    return found[0]


def fields(df: DataFrame, names: Iterable[str]) -> list[T.StructField]:
    return [field(df, n) for n in names]


def hashable(df: DataFrame, names: Sequence[str]) -> list[T.StructField]:
    """The fields, all of a hashable type; at least one."""
    if not names:
        raise ValueError("no columns given")
    found = fields(df, names)
    for f in found:
        if not isinstance(f.dataType, HASHABLE):
            raise UnsupportedType(f"column {f.name!r} is {f.dataType.simpleString()}")
    return found


def string_field(df: DataFrame, name: str) -> T.StructField:
    found = field(df, name)
    if not isinstance(found.dataType, T.StringType):
        raise UnsupportedType(f"column {name!r} is {found.dataType.simpleString()}, not a string")
    return found


def registered(registry: dict, version: str, what: str):
    """The entry of a frozen version; an unknown one is an error, never the newest."""
    if version not in registry:
        raise ValueError(f"unknown {what} version {version!r}; there are {sorted(registry)}")
    return registry[version]


def require_conf(df: DataFrame, key: str, value: str) -> None:
    if df.sparkSession.conf.get(key).lower() != value:
        raise ConfigError(f"{key} must be {value}; see basalt.session.configure")
