"""Structured differences of schemas; no job runs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..errors import SchemaMismatch
from ..metrics import instrumented

# The types that may stand where a wider one is expected.
WIDENINGS: dict[type, tuple[type, ...]] = {
    T.ShortType: (T.ByteType,),
    T.IntegerType: (T.ByteType, T.ShortType),
    T.LongType: (T.ByteType, T.ShortType, T.IntegerType),
    T.DoubleType: (T.FloatType,),
}


@dataclass(frozen=True)
class Retyped:
    name: str
    expected: str
    actual: str


@dataclass(frozen=True)
class NullabilityChange:
    name: str
    expected_nullable: bool
    actual_nullable: bool


@dataclass(frozen=True)
class SchemaDiff:
    """Missing in the order of the expected schema, unexpected in that of the actual one."""

    missing: list[str] = field(default_factory=list)
    unexpected: list[str] = field(default_factory=list)
    retyped: list[Retyped] = field(default_factory=list)
    nullability: list[NullabilityChange] = field(default_factory=list)

    @property
    def is_empty(self) -> bool:
        return not (self.missing or self.unexpected or self.retyped or self.nullability)

    @property
    def is_breaking(self) -> bool:
        """An additional column alone breaks nothing."""
        return bool(self.missing or self.retyped or self.nullability)


Schema = DataFrame | T.StructType | str


def struct_of(schema: Schema) -> T.StructType:
    """The schema of a DataFrame, a StructType or a DDL string."""
    if isinstance(schema, T.StructType):
        return schema
    if isinstance(schema, str):
        return T.StructType.fromDDL(schema)
    return schema.schema


def is_numeric_widening(expected: T.DataType, actual: T.DataType) -> bool:
    return type(actual) in WIDENINGS.get(type(expected), ())


@instrumented
def validate_schema(actual: Schema, expected: Schema, allow_numeric_widening: bool = False) -> SchemaDiff:
    """How the actual schema differs from the expected one, by exact names.

    A null where none is expected is a difference; the reverse is not. An allowed
    widening doesn't hide a difference of nullability.
    """
    have, want = struct_of(actual), struct_of(expected)
    for s in (have, want):
        if len(set(s.names)) < len(s.names):
            raise SchemaMismatch(f"column names repeat: {s.names}")
    by_name = {f.name: f for f in have.fields}
    retyped, nullability = [], []
    for f in want.fields:
        found = by_name.get(f.name)
        if found is None:
            continue
        if found.dataType != f.dataType and not (allow_numeric_widening and is_numeric_widening(f.dataType, found.dataType)):
            retyped.append(Retyped(f.name, f.dataType.simpleString(), found.dataType.simpleString()))
        if found.nullable and not f.nullable:
            nullability.append(NullabilityChange(f.name, f.nullable, found.nullable))
    return SchemaDiff([n for n in want.names if n not in by_name], [n for n in have.names if n not in set(want.names)], retyped, nullability)
