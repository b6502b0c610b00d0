"""Type-aware row hashes, order-independent table fingerprints, schema fingerprints.

A row hash chains, for every column in turn, its type, whether it is null, and its
value: null differs from the empty string, 5 from true, a date from its day number,
and 5.00 from 5. All NaNs are one value, and so are 0.0 and -0.0. The hash is a signed
64-bit number and depends on the order of the columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaMismatch
from ..metrics import instrumented
from ..resolve import col, hashable, registered

#: Start of a version's hashes and fingerprints, from its name.
_SEEDS = {v: int.from_bytes(hashlib.blake2b(f"basalt row hash {v}".encode(), digest_size=8).digest(), "little", signed=True) for v in ("v1",)}
_WIDTH = 1 << 64


def _value(f: T.StructField) -> Column:
    c = col(f.name)
    if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
        kind = f.dataType.simpleString()
        return F.when(F.isnan(c), F.lit(float("nan")).cast(kind)).when(c == 0, F.lit(0.0).cast(kind)).otherwise(c)
    return c


def row_hash(df: DataFrame, columns: Sequence[str], version: str = "v1") -> Column:
    """The hash of the named columns as an expression; stays in generated code."""
    seed = registered(_SEEDS, version, "hash")
    parts = [x for f in hashable(df, columns) for x in (F.lit(f.dataType.simpleString()), col(f.name).isNull(), _value(f))]
    return F.xxhash64(F.lit(seed), *parts)


@instrumented
def hash_rows(df: DataFrame, columns: Sequence[str], output_column: str = "row_hash", version: str = "v1") -> DataFrame:
    """df with the hash as its last column."""
    if output_column in df.columns:
        raise SchemaMismatch(f"there is a column {output_column!r}")
    return df.select("*", row_hash(df, columns, version).alias(output_column))


@instrumented
def hash_rows_all_columns(df: DataFrame, output_column: str = "row_hash", version: str = "v1") -> DataFrame:
    return hash_rows(df, df.columns, output_column, version)


def fingerprint_sums(hashes: Column) -> list[Column]:
    """Sums of the four 16-bit limbs, lowest first: none leaves a long before 2^47 rows."""
    limbs = [F.shiftrightunsigned(hashes, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    return [F.coalesce(F.sum(x), F.lit(0)) for x in limbs]


def fingerprint_of(sums: Sequence[int], version: str = "v1") -> int:
    """The fingerprint of fingerprint_sums' results."""
    total = sum(int(x) << (16 * i) for i, x in enumerate(sums))
    return (registered(_SEEDS, version, "hash") + total) % _WIDTH


@instrumented
def table_fingerprint(df: DataFrame, columns: Sequence[str] | None = None, version: str = "v1") -> int:
    """The wrapped sum of all row hashes: the same for any order of rows, another if a row comes once more. An empty table has the version's seed."""
    hashed = df.select(row_hash(df, columns or df.columns, version).alias("h"))
    return fingerprint_of(hashed.agg(*fingerprint_sums(F.col("h"))).first(), version)


@instrumented
def schema_fingerprint(schema: DataFrame | T.StructType, version: str = "v1") -> int:
    """A digest of names, types and nullability in order; each part with its length."""
    registered(_SEEDS, version, "hash")
    schema = schema if isinstance(schema, T.StructType) else schema.schema
    digest = hashlib.blake2b(digest_size=8)
    for f in schema.fields:
        for part in (f.name.encode(), f.dataType.simpleString().encode(), bytes([f.nullable])):
            digest.update(len(part).to_bytes(8, "little") + part)
    return int.from_bytes(digest.digest(), "little")
