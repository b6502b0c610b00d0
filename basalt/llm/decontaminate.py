"""Operator 10, benchmark decontamination: Wu-Manber search for many word sequences.

Texts become sequences of words. Each pattern is a window of an item. Patterns of
one length are searched together: a table of shifts by the last block (two words)
of the search window skips what no pattern can match, a shift of 0 leads to the
bucket of the patterns with that suffix block, and the words decide.

The patterns reach the tasks by broadcast in blocks of at most ``BLOCK_BYTES`` of
item text; the size is measured first. A block is compiled once in each Python
process, into arrays of some 8 times its text, and the block before it is dropped, so
a benchmark of any size needs the memory of one block there and on the driver. Each
block is a pass over the documents.

Defined results: null and empty texts have no words and no hits; a null item_id
counts as an item under the empty string; items with equal windows are all found;
repeated rows are judged one by one; with an empty benchmark nothing is hit; an
empty table gives an empty result; of either table only the named columns are looked
at, whatever the others are called; a very long text is searched in one go, in time
in proportion.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import backquoted, ship, tidied, written

WINDOW = 13
#: Bytes of item text in one broadcast block of patterns.
BLOCK_BYTES = 8_000_000

# Bytes of words (after lower-casing A-Z): digits, letters and whatever is not ASCII.
_TO_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


class WuManber:
    """Patterns of one length, in arrays.

    ``shift`` has a byte for each hash of a block: how far the window may move. The
    patterns themselves are the item words that end one: ``keys`` are the sorted
    hashes of suffix block and first word, ``ends`` the places of the last words in
    ``flat``, where the items' words stand with spaces between them.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], length: int):
        self.length, self.block = length, min(2, length)
        self.names = [name for name, _ in items]
        sizes = np.fromiter((len(seq) for _, seq in items), np.int64, len(items))
        self.item_begins = np.cumsum(sizes) - sizes
        self.flat = b" ".join(b" ".join(seq) for _, seq in items)
        lengths = np.fromiter((len(w) for _, seq in items for w in seq), np.int64, int(sizes.sum()))
        self.word_ends = np.cumsum(lengths + 1) - 1
        self.word_begins = self.word_ends - lengths
        # A block at place p of an item ends a window there, or stands that far before the end of the item's first.
        blocks = np.fromiter((h for _, seq in items for h in self._blocks(seq)), np.int64, int(sizes.sum()))
        place = np.arange(len(blocks)) - np.repeat(self.item_begins, sizes)
        real = place >= self.block - 1
        self.mask = (1 << max(12, int(len(blocks) * 8).bit_length())) - 1
        shift = np.full(self.mask + 1, length - self.block + 1, np.uint8)
        np.minimum.at(shift, blocks[real] & self.mask, np.maximum(length - 1 - place[real], 0).astype(np.uint8))
        self.shift = shift.tobytes()
        keys = np.fromiter((h for _, seq in items for h in self._suffixes(seq)), np.int64)
        ends = np.flatnonzero(place >= length - 1)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ends = keys[order], ends[order]

    def _blocks(self, seq: list[bytes]) -> list[int]:
        return [0, *map(hash, zip(seq, seq[1:], strict=False))] if self.block == 2 else [hash((w,)) for w in seq]

    def _suffixes(self, seq: list[bytes]) -> list[int]:
        n = self.length
        return [hash((seq[i - 2], seq[i - 1], seq[i - n])) for i in range(n, len(seq) + 1)] if self.block == 2 else [hash((w,)) for w in seq]

    @property
    def nbytes(self) -> int:
        arrays = (self.item_begins, self.word_begins, self.word_ends, self.keys, self.ends)
        return len(self.flat) + len(self.shift) + sum(a.nbytes for a in arrays) + sum(60 + len(n) for n in self.names)

    def search(self, seq: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """(start, items) of every occurrence, by start."""
        end, n, length, shift, mask = self.length, len(seq), self.length, self.shift, self.mask
        found, keys = [], []
        if self.block == 2:
            while end <= n:
                skip = shift[hash((seq[end - 2], seq[end - 1])) & mask]
                if not skip:
                    found.append(end)
                    keys.append(hash((seq[end - 2], seq[end - 1], seq[end - length])))
                    skip = 1
                end += skip
        else:
            keys = [hash((w,)) for w in seq]
            found = [i + 1 for i, k in enumerate(keys) if not shift[k & mask]]
            keys = [keys[i - 1] for i in found]
        if not found:
            return
        wanted = np.array(keys, np.int64)
        low, high = np.searchsorted(self.keys, wanted), np.searchsorted(self.keys, wanted, side="right")
        for i in np.flatnonzero(low < high).tolist():
            end = found[i]
            text = b" ".join(seq[end - length : end])
            ends = self.ends[low[i] : high[i]]
            begins = self.word_begins[ends - length + 1]
            same = [e for e, a, z in zip(ends.tolist(), begins.tolist(), self.word_ends[ends].tolist(), strict=True) if self.flat[a:z] == text]
            if same:
                owners = np.unique(np.searchsorted(self.item_begins, same, side="right") - 1)
                yield end - length, [self.names[k] for k in owners.tolist()]


def compile_items(items: list[tuple[str, str]], window: int = WINDOW) -> list[WuManber]:
    """One searcher for each length of pattern in (item_id, text)."""
    by_length: dict[int, list] = defaultdict(list)
    for item, text in items:
        seq = words(text)
        if seq:
            by_length[min(window, len(seq))].append((item, seq))
    return [WuManber(some, length) for length, some in sorted(by_length.items())]


def hits(searchers: list[WuManber], seq: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged (begin, end) ranges of words inside occurrences, and the items."""
    spans, items = [], set()
    for one in searchers:
        for start, owners in one.search(seq):
            spans.append((start, start + one.length))
            items.update(owners)
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged, items


#: The block that this process searches with: its name and its searchers.
_current: list = [None, []]


def _searchers(name: str, shared, window: int) -> list[WuManber]:
    """The searchers of a block, compiled once a process; those of the block before go first."""
    if _current[0] != name:
        _current[:] = [None, []]
        ids, texts = pa.ipc.open_stream(shared.value).read_all().columns
        _current[:] = [name, compile_items(list(zip(ids.to_pylist(), texts.to_pylist(), strict=True)), window)]
    return _current[1]


def _search(name: str, shared, window: int, all_rows: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            searchers = _searchers(name, shared, window)
            at, n, spans, items = [], [], [], []
            for i, text in enumerate(batch.column("text")):
                seq = words(text.as_py() or "")
                merged, owners = hits(searchers, seq)
                if all_rows or merged:
                    at.append(i)
                    n.append(len(seq) if all_rows else None)
                    spans.append([x for span in merged for x in span])
                    items.append(sorted(owners))
            rows = batch.take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("tie"), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
                names=["doc_id", "tie", "n_words", "spans", "items"],
            )

    return run


def blocks_of(benchmark: DataFrame, block_bytes: int) -> int:
    """Into how many blocks of about block_bytes of text the items are cut."""
    size = benchmark.agg(F.sum(F.octet_length("text") + F.lit(16))).first()[0] or 0
    return max(1, -(-int(size) // block_bytes))


def _block(items: DataFrame) -> bytes:
    """The items of one block, as they are sent to the tasks."""
    out = pa.BufferOutputStream()
    table = items.select("item_id", "text").toArrow()
    with pa.ipc.new_stream(out, table.schema) as stream:
        stream.write_table(table)
    return out.getvalue().to_pybytes()


def contaminated_words(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, tie, n_words, spans (flat begin, end pairs of words) and items of each row of docs (doc_id, tie, text)."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, tie long, n_words long, spans array<long>, items array<string>"
    n = blocks_of(benchmark, block_bytes)
    if n == 1:
        shared = spark.sparkContext.broadcast(_block(benchmark))
        return docs.mapInArrow(tidied(_search(uuid.uuid4().hex, shared, window, True)), schema)
    found = None
    for block in range(n):
        # One block at a time is on the driver and with the tasks; of later ones only rows with hits are written.
        shared = spark.sparkContext.broadcast(_block(benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block)))
        one = written(docs.mapInArrow(tidied(_search(uuid.uuid4().hex, shared, window, block == 0)), schema), "hits")
        shared.destroy()
        found = one if found is None else found.unionByName(one)
    # A text alone decides its rows, so equal rows agree, and a set holds no more than one entry a block.
    return found.groupBy("doc_id", "tie").agg(
        F.max("n_words").alias("n_words"),
        F.collect_set(F.struct("spans", "items")).alias("h"),
        F.count("n_words").cast("int").alias("copies"),
    ).select(
        "doc_id", "tie", "n_words", F.flatten("h.spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten("h.items"))).alias("items"), F.explode(F.sequence(F.lit(1), "copies"))
    ).select("doc_id", "tie", "n_words", _merged("spans").alias("spans"), "items")


def _merged(spans: str):
    """Flat begin, end pairs in any order, merged."""
    n = (F.size(spans) / 2).cast("int")
    pairs = F.array_sort(F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.named_struct(F.lit("a"), F.get(spans, i * 2), F.lit("b"), F.get(spans, i * 2 + 1)))))
    empty = F.array().cast("array<long>")

    def add(acc, p):
        last = F.element_at(acc, -1)
        return F.when((F.size(acc) > 0) & (p["a"] <= last), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.greatest(last, p["b"])))).otherwise(
            F.concat(acc, F.array(p["a"], p["b"]))
        )

    return F.coalesce(F.aggregate(pairs, empty, lambda acc, p: F.when(F.size(acc) == 0, F.array(p["a"], p["b"])).otherwise(add(acc, p))), empty)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """n_words, n_hit, n_items, items_sha256 and contaminated of each row of docs."""
    ship(docs.sparkSession)
    t = F.col(backquoted(text))
    source = docs.select(F.col(backquoted(key)).alias("doc_id"), F.xxhash64(t).alias("tie"), t.alias("text"))
    items = benchmark.select(F.coalesce(F.col(backquoted(item)).cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col(backquoted(item_text)), F.lit("")).alias("text"))
    found = contaminated_words(source, items, window, block_bytes)
    # Subtracting in turn: of flat pairs a, b, c, d this leaves (b - a) + (d - c).
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: x - acc), F.lit(0)).cast("long")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


