"""JSON objects in a string column to typed columns, strictly, with counts of what didn't fit.

A value is taken only if its JSON type is the target's: a string for STRING, an
integer that fits for BIGINT, any number for DOUBLE, true or false for BOOLEAN.
Anything else gives null and counts as a mismatch; a missing key or a JSON null
gives null and doesn't. A row that is no JSON object (null rows too) is malformed. A
dotted name walks through objects, at any depth.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaMismatch, UnsupportedType
from ..metrics import instrumented
from ..resolve import col, registered, require_conf, string_field
from ..resolve import field as field_of

VERSIONS = {"v1": None}
_TARGETS = {T.StringType: "string", T.LongType: "bigint", T.DoubleType: "double", T.BooleanType: "boolean"}
_TEXT, _VALUE, _OK = "__text", "__json", "__ok"
#: Start of the numbers behind the texts.
_SEAL = 0x62617361


@dataclass(frozen=True)
class NormalizeStats:
    rows: int
    rows_malformed: int
    type_mismatches: dict[str, int] = field(default_factory=dict)


def _checked(schema: T.StructType | str) -> T.StructType:
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    for f in schema.fields:
        if type(f.dataType) not in _TARGETS:
            raise UnsupportedType(f"target {f.name!r}: {f.dataType.simpleString()}")
        if not f.nullable:
            raise SchemaMismatch(f"target {f.name!r} must be nullable: any row may lack it")
    if len(set(schema.names)) < len(schema.names):
        raise SchemaMismatch(f"target names repeat: {schema.names}")
    return schema


def _path(name: str) -> str:
    """The path to a dotted name below the wrapper."""
    return "$[0]" + "".join("[" + '"' + part.replace("\\", "\\\\").replace('"', '\\"') + '"' + "]" for part in name.split("."))


def _parsed(df: DataFrame, column: str) -> DataFrame:
    """df with the value inside an array, and whether it is one well-formed object.

    The parser stops behind a first value and would accept what follows, so the text
    is parsed as the first of an array's two elements. The second is a number that
    depends on the text: an array that the text itself closes or lengthens hasn't it.
    """
    c = col(column)
    seal = F.xxhash64(F.lit(_SEAL), c)
    value = F.try_parse_json(F.concat(F.lit("["), c, F.lit(","), seal.cast("string"), F.lit("]")))
    df = df.select("*", value.alias(_VALUE))
    kind = F.schema_of_variant(F.try_variant_get(F.col(_VALUE), "$[0]", "variant"))
    sealed = F.try_variant_get(F.col(_VALUE), "$[1]", "bigint").eqNullSafe(seal)
    return df.select("*", F.coalesce(sealed & kind.startswith("OBJECT"), F.lit(False)).alias(_OK))


def _extracted(f: T.StructField) -> tuple[Column, Column]:
    """The typed value, and whether there was one of another type."""
    path, target = _path(f.name), _TARGETS[type(f.dataType)]
    kind = F.when(F.col(_OK), F.schema_of_variant(F.try_variant_get(F.col(_VALUE), path, "variant")))
    fits = {
        "string": kind == "STRING",
        "bigint": kind == "BIGINT",
        "boolean": kind == "BOOLEAN",
        "double": (kind == "BIGINT") | (kind == "DOUBLE") | (kind == "FLOAT") | kind.startswith("DECIMAL"),
    }[target]
    value = F.when(fits, F.try_variant_get(F.col(_VALUE), path, target))
    return value, F.coalesce(kind.isNotNull() & (kind != "VOID") & ~fits, F.lit(False))


def _prepared(df: DataFrame, column: str, schema: T.StructType | str, version: str, keep: Sequence[str]) -> tuple[DataFrame, list[T.StructField]]:
    """The kept columns and the text, parsed, and the targets."""
    registered(VERSIONS, version, "normalize")
    string_field(df, column)
    schema = _checked(schema)
    require_conf(df, "spark.sql.variant.allowDuplicateKeys", "true")
    if clash := set(keep) & {*schema.names}:
        raise SchemaMismatch(f"kept columns are named like targets: {sorted(clash)}")
    kept = [field_of(df, n).name for n in keep]
    return _parsed(df.select(*[col(n) for n in kept], col(column).alias(_TEXT)), _TEXT), schema.fields


def _targets(parsed: DataFrame, fields: list[T.StructField], keep: Sequence[str]) -> DataFrame:
    return parsed.select(*[col(n) for n in keep], *[_extracted(f)[0].alias(f.name) for f in fields])


def _counts(fields: list[T.StructField]) -> list[Column]:
    """Rows, malformed rows, and mismatches of each target."""
    return [F.count(F.lit(1)).alias("rows"), F.count_if(~F.col(_OK)).alias("malformed"), *[F.count_if(_extracted(f)[1]).alias(f"t{i}") for i, f in enumerate(fields)]]


def _stats(fields: list[T.StructField], found) -> NormalizeStats:
    n, malformed, *mismatches = found
    return NormalizeStats(n, malformed, dict(zip([f.name for f in fields], mismatches, strict=True)))


def normalize_columns(df: DataFrame, column: str, schema: T.StructType | str, version: str = "v1", keep: Sequence[str] = ()) -> DataFrame:
    """The columns of keep and the target columns, one row for each row of df; stays lazy and native."""
    parsed, fields = _prepared(df, column, schema, version, keep)
    return _targets(parsed, fields, keep)


def normalize_stats(df: DataFrame, column: str, schema: T.StructType | str, version: str = "v1") -> NormalizeStats:
    """The counts alone, by one aggregate."""
    parsed, fields = _prepared(df, column, schema, version, ())
    return _stats(fields, parsed.agg(*_counts(fields)).first())


class PendingStats:
    """Counts that are made while the rows are read for the first time.

    The first action over the rows should read all of them, as writing does. If none
    has run when the counts are asked for, one is run that only reads.
    """

    def __init__(self, seen: Observation, rows: DataFrame, fields: list[T.StructField]):
        self._seen, self._rows, self._fields, self._found = seen, rows, fields, None

    def get(self) -> NormalizeStats:
        if self._found is None:
            # An action that has just ended may not be told of yet.
            self._rows.sparkSession.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
            if not self._seen._jo.future().isCompleted():
                self._rows.write.format("noop").mode("overwrite").save()
            got = self._seen.get
            self._found = _stats(self._fields, [got["rows"], got["malformed"], *[got[f"t{i}"] for i in range(len(self._fields))]])
        return self._found

    rows = property(lambda self: self.get().rows)
    rows_malformed = property(lambda self: self.get().rows_malformed)
    type_mismatches = property(lambda self: self.get().type_mismatches)


@instrumented
def normalize_json(df: DataFrame, column: str, schema: T.StructType | str, version: str = "v1", keep: Sequence[str] = ()) -> tuple[DataFrame, PendingStats]:
    """The columns of keep with the target columns, and the counts: both from one pass over df, the first that reads the rows."""
    parsed, fields = _prepared(df, column, schema, version, keep)
    seen = Observation()
    out = _targets(parsed.observe(seen, *_counts(fields)), fields, keep)
    return out, PendingStats(seen, out, fields)
