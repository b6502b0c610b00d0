"""Row-local operators on streams: hash, cleanup and JSON extraction work unchanged.

Deduplication and aggregation need a watermark on a stream; here deduplication
within one is offered, whose state is bounded by it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..errors import ConfigError
from ..functions.cleanup import clean_with_preset, clean_with_rules
from ..functions.json_normalize import normalize_columns
from ..operators.hashing import hash_rows
from ..resolve import field, hashable

__all__ = ["clean_with_preset", "clean_with_rules", "drop_duplicates_within", "hash_rows", "normalize_columns"]


def drop_duplicates_within(df: DataFrame, columns: Sequence[str], event_time: str, delay: str) -> DataFrame:
    """The first row of each key on a stream; a key is forgotten ``delay`` after its time, a TIMESTAMP column."""
    if not df.isStreaming:
        raise ConfigError("a stream is needed; tables have drop_duplicates")
    names = [f.name for f in hashable(df, columns)]
    return df.withWatermark(field(df, event_time).name, delay).dropDuplicatesWithinWatermark(names)
