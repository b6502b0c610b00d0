"""Operator 7, token files: ids as directly addressable codes.

File format (little endian):

    8 bytes   magic ``BDAC0001``
    4 x u64   documents, tokens, levels, bits of a chunk (8)
    u64[d]    doc_id of each document, as a two's complement
    u64[d+1]  index of the first token of each document, and the end
    then for each level:
    u64       entries of the level
    u8[n]     chunk of each entry, least significant first
    u8[n/8]   continuation bitmap: has the entry a chunk in the next level
    u32[b+1]  rank directory: ones before each block of BLOCK entries

Token i has chunk i of level 0; where its bit is set, its next chunk is entry
rank(i) of the next level, so any token is reached without decoding others.

Defined results: null is an empty text (its end id only); rows are ordered by
doc_id, null ids first, and those of one doc_id by a hash of the text; repeated
rows are written as often as they come; an empty table writes no file and gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from struct import pack
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import backquoted, shared_dir, ship, written
from .units import UnitEncoder

MAGIC, BITS, BLOCK = b"BDAC0001", 8, 512
#: Tokens after which a file is closed; bounds what a writer and a reader hold.
FILE_TOKENS = 4_000_000
NULL_ID = -(1 << 63)
#: Tasks that read files, if there are as many files.
READ_TASKS = 20_000


def encode_dac(doc_ids: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> bytes:
    """The file of these documents; starts has one entry more than doc_ids."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = (rest >> BITS) > 0
        bits = np.packbits(more, bitorder="little")
        sums = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint32) if len(more) else np.zeros(0, np.uint32)
        ranks = np.concatenate([np.zeros(1, np.uint32), np.cumsum(sums, dtype=np.uint32)])
        levels.append(np.array([len(rest)], "<u8").tobytes() + (rest & 0xFF).astype(np.uint8).tobytes() + bits.tobytes() + ranks.astype("<u4").tobytes())
        rest = rest[more] >> BITS
        if not len(rest):
            break
    head = np.array([len(doc_ids), len(ids), len(levels), BITS], "<u8").tobytes()
    return MAGIC + head + doc_ids.astype("<i8").tobytes() + starts.astype("<u8").tobytes() + b"".join(levels)


class DacFile:
    """Random access to the tokens of one file's bytes."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        self.n_docs, self.n_tokens, n_levels, bits = np.frombuffer(data, "<u8", 4, 8).tolist()
        if bits != BITS:
            raise ValueError(f"chunks of {bits} bits")
        at = 40
        self.doc_ids = np.frombuffer(data, "<i8", self.n_docs, at)
        at += 8 * self.n_docs
        self.starts = np.frombuffer(data, "<u8", self.n_docs + 1, at).astype(np.int64)
        at += 8 * (self.n_docs + 1)
        self.levels = []
        for _ in range(n_levels):
            n = int(np.frombuffer(data, "<u8", 1, at)[0])
            at += 8
            chunks = np.frombuffer(data, np.uint8, n, at)
            at += n
            bitmap = np.frombuffer(data, np.uint8, (n + 7) // 8, at)
            at += len(bitmap)
            ranks = np.frombuffer(data, "<u4", (n + BLOCK - 1) // BLOCK + 1, at)
            at += 4 * len(ranks)
            self.levels.append((chunks, bitmap, ranks))

    def _rank(self, level: int, i: int) -> int:
        """Ones before entry i: the directory, then at most one block's bits."""
        _, bitmap, ranks = self.levels[level]
        block = i // BLOCK
        whole = bitmap[block * BLOCK // 8 : i // 8]
        ones = int(ranks[block]) + int(np.bitwise_count(whole).sum())
        return ones + (int(bitmap[i // 8]) & ((1 << i % 8) - 1)).bit_count() if i % 8 else ones

    def token(self, i: int) -> int:
        """Token i alone."""
        value, shift = 0, 0
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[i]) << shift
            if not bitmap[i // 8] >> (i % 8) & 1:
                break
            i, shift = self._rank(level, i), shift + BITS
        return value

    def tokens(self, begin: int, end: int) -> np.ndarray:
        """Tokens begin to end as 32-bit numbers; only their own entries are read."""
        out = np.zeros(end - begin, "<u4")
        places = None
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            if end <= begin:
                break
            part = chunks[begin:end].astype(np.uint32) << np.uint32(BITS * level)
            if places is None:
                out += part
            else:
                out[places] += part
            low = begin // 8
            more = np.unpackbits(bitmap[low : (end + 7) // 8], bitorder="little")[begin - 8 * low : end - 8 * low].astype(bool)
            places = np.flatnonzero(more) if places is None else places[more]
            if not len(places):
                break
            begin = self._rank(level, begin)
            end = begin + len(places)
        return out


def _file_system(uri: str):
    """pyarrow's file system and path of a URI: local, HDFS or an object store."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _put(uri: str, data: bytes) -> None:
    """A file appears under its name only when it is whole; a retried task puts the same bytes."""
    store, path = _file_system(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, path)


def _get(uri: str) -> bytes:
    store, path = _file_system(uri)
    with store.open_input_file(path) as source:
        return source.read()


def _writer(path: str, folder: str, end_id: int, file_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder = TaskContext.get().partitionId(), UnitEncoder(path, lambda ids: pack(f"<{len(ids)}I", *ids))
        last, count, doc_ids, pieces, sizes, total = np.array([end_id], "<u4").tobytes(), 0, [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal count, doc_ids, pieces, sizes, total
            name = f"{folder}/{part:06d}-{count:06d}.dac"
            starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)])
            _put(name, encode_dac(np.array(doc_ids, np.int64), starts, np.frombuffer(b"".join(pieces), "<u4")))
            row = pa.RecordBatch.from_pylist([{"part": part, "number": count, "file": name, "n_docs": len(doc_ids), "n_tokens": total}], _MANIFEST)
            count, doc_ids, pieces, sizes, total = count + 1, [], [], [], 0
            return row

        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                data = b"".join([*encoder.values(text.as_py() or ""), last])
                doc_ids.append(NULL_ID if key is None else key)
                pieces.append(data)
                sizes.append(len(data) // 4)
                total += sizes[-1]
                if total >= file_tokens:
                    yield close()
        if doc_ids:
            yield close()

    return run


_MANIFEST = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = 0, key: str = "doc_id", text: str = "text", file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write the ids of all texts, each followed by end_id, in ascending order of key.

    Returns the manifest: one row a file, with the global index of its first token
    (``start``). Files hold contiguous ranges of the order. folder: a URI that all
    executors can write to; a new one below spark.checkpoint.dir if not given.
    """
    ship(docs.sparkSession)
    folder = folder or shared_dir(docs.sparkSession, "tokens")
    source = docs.select(F.col(backquoted(key)).cast("long").alias("doc_id"), F.col(backquoted(text)).alias("text"), F.xxhash64(backquoted(text)).alias("tie"))
    ordered = source.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    # Written at once: the files are made in this one run of the tasks.
    files = written(ordered.mapInArrow(_writer(tokenizer_path, folder, end_id, file_tokens), "part int, number int, file string, n_docs long, n_tokens long"), "manifest")
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("in_part"))
    before = parts.select("part", (F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("number")) - F.col("n_tokens")
    return files.withColumn("within", within).join(before, "part").select("file", "n_docs", "n_tokens", (F.col("before") + F.col("within")).alias("start"))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                found = DacFile(_get(name))
                bounds = found.starts.tolist()
                crc = [zlib.crc32(found.tokens(a, b).tobytes()) for a, b in zip(bounds, bounds[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.doc_ids, mask=found.doc_ids == NULL_ID), pa.array(base + found.starts[:-1]), pa.array(np.diff(found.starts)), pa.array(crc, pa.int64())],
                    schema=_DOCS,
                )

    # A number of tasks is given: by their own small size the rows would all go to one.
    tasks = min(max(manifest.count(), 1), READ_TASKS)
    return manifest.select("file", "start").repartition(tasks, "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
