"""Texts in packs: bounded, compressed groups of documents that the exact repeat finders ask and answer for.

A pack is one row: its number, the ids and sizes of its documents, and their texts
end to end under zstandard. Packs are written once; what later passes learn about a
pack comes back to it by its number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import backquoted, written
from .repeats import mix

#: Bytes of text, and documents, after which a pack is closed.
PACK_BYTES, PACK_DOCS = 6_000_000, 20_000
#: Bytes of all texts for each part that an exchange is cut into at least.
PART_BYTES = 64_000_000

PACK_SCHEMA = "pack long, doc_ids array<long>, sizes array<long>, body binary"


def packed(docs: DataFrame, key: str, text: str, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """The packs of docs. A null text is an empty one; rows that repeat are packed as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdCompressor

        part, count, squeeze = TaskContext.get().partitionId(), 0, ZstdCompressor(level=3).compress
        ids: list = []
        texts: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal count, ids, texts, size
            row = {"pack": part << 32 | count, "doc_ids": ids, "sizes": [len(t) for t in texts], "body": squeeze(b"".join(texts))}
            count, ids, texts, size = count + 1, [], [], 0
            return pa.RecordBatch.from_pylist([row], pa.schema([("pack", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("body", pa.binary())]))

        for batch in batches:
            for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                data = (value.as_py() or "").encode("utf-8", "surrogatepass")
                ids.append(doc_id)
                texts.append(data)
                size += len(data)
                if size >= pack_bytes or len(ids) >= PACK_DOCS:
                    yield close()
        if ids:
            yield close()

    source = docs.select(F.col(backquoted(key)).cast("long").alias("doc_id"), F.col(backquoted(text)).alias("text"))
    return written(source.mapInArrow(run, PACK_SCHEMA), "packs")


def n_parts(packs: DataFrame, part_bytes: int = PART_BYTES) -> int:
    """Parts of an exchange: by the size of the texts, and no fewer than the session's shuffle partitions."""
    size = packs.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    return max(int(packs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // part_bytes))


def texts_in(row: dict) -> list[bytes]:
    """The texts of a pack's row."""
    from zstandard import ZstdDecompressor

    body = ZstdDecompressor().decompress(row["body"], max_output_size=sum(row["sizes"])) if sum(row["sizes"]) else b""
    ends = np.cumsum(row["sizes"]).tolist()
    return [body[e - s : e] for s, e in zip(row["sizes"], ends, strict=True)]


def digit(keys: np.ndarray, parts: int) -> np.ndarray:
    """The most significant digit, to the base of ``parts``, of mixed keys."""
    return ((mix(keys) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def split_counts(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The parts that sorted keys fall into by their high bits, and where each begins."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    return np.unique(part, return_index=True)


def with_rows(packs: DataFrame, rows: DataFrame, work: Callable[[dict, pa.Table], Iterator[pa.RecordBatch]], schema: pa.Schema, spark_schema: str) -> DataFrame:
    """work(pack, its rows) of every pack, those without a row too."""

    def run(pack: pa.Table, own: pa.Table) -> pa.Table:
        return pa.Table.from_batches([b for row in pack.to_pylist() for b in work(row, own)], schema)

    return packs.groupBy("pack").cogroup(rows.groupBy("pack")).applyInArrow(run, spark_schema)
