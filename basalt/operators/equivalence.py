"""Whether two tables hold the same rows, in any order.

The fast way compares schemas, counts and fingerprints of the shared columns; the
exact way also compares the multisets of rows. Columns of different types never
match, also where the schema check allows the widening.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..metrics import instrumented
from ..resolve import col, field
from .hashing import fingerprint_of, fingerprint_sums, row_hash
from .schema_check import SchemaDiff, validate_schema


@dataclass(frozen=True)
class EquivalenceReport:
    schema_diff: SchemaDiff
    actual_rows: int
    expected_rows: int
    fingerprints_match: bool
    exact_match: bool | None = None

    @property
    def is_equivalent(self) -> bool:
        return self.schema_diff.is_empty and self.actual_rows == self.expected_rows and self.fingerprints_match and self.exact_match is not False


def _measured(df: DataFrame, columns: Sequence[str], version: str) -> tuple[int, int]:
    """Rows and fingerprint, in one pass; without columns every row counts alike."""
    hashes = row_hash(df, columns, version) if columns else F.lit(0).cast("long")
    n, *sums = df.select(hashes.alias("h")).agg(F.count(F.lit(1)), *fingerprint_sums(F.col("h"))).first()
    return n, fingerprint_of(sums, version)


def _same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal multisets: counts of each row, one side's taken from the other's, all zero. One exchange for both directions."""
    names = a.columns
    tagged = a.select("*", F.lit(1).alias("__n")).unionByName(b.select("*", F.lit(-1).alias("__n")))
    return tagged.groupBy(*[col(n) for n in names]).agg(F.sum("__n").alias("__n")).where("__n <> 0").isEmpty()


@instrumented
def check_equivalence(
    actual: DataFrame, expected: DataFrame, columns: Sequence[str] | None = None, allow_numeric_widening: bool = False, hash_version: str = "v1", exact: bool = False
) -> EquivalenceReport:
    """A report on the rows of two tables, over ``columns`` or those that both have, in the order of expected.

    The schemas are always compared whole.
    """
    diff = validate_schema(actual, expected, allow_numeric_widening)
    shared = list(columns) if columns is not None else [n for n in expected.columns if n in set(actual.columns)]
    same_types = all(field(actual, n).dataType == field(expected, n).dataType for n in shared)
    (n_actual, of_actual), (n_expected, of_expected) = (_measured(df, shared, hash_version) for df in (actual, expected))
    exact_match = None
    if exact:
        exact_match = same_types and n_actual == n_expected and (not shared or _same_rows(*[df.select(*[col(n) for n in shared]) for df in (actual, expected)]))
    return EquivalenceReport(diff, n_actual, n_expected, of_actual == of_expected, exact_match)
