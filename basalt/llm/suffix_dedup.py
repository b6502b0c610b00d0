"""Operator 4, suffix-array dedup: a depth-limited radix sort of suffixes by their bytes.

Suffixes are told apart only through the threshold's bytes, so a suffix of depth
``length`` is a window. They are sorted by most-significant-digit passes: a digit is
8 bytes, a pass parts each group by its next digit, a group of one retires at once,
and the groups that are left at full depth are exactly the repeated windows.

Most suffixes retire together, without being moved. Every window has an anchor (see
``repeats``), the same one in all its copies, and consecutive windows share theirs.

1. The suffixes that begin at anchors are sorted to the anchor's depth. The bytes of
   each are sent to a part of the exchange, where the passes run. All windows of an
   anchor that comes once retire with it.
2. The other windows are sorted to full depth, those of one different context (the
   bytes of all windows that an anchor names) for all its copies. They are sent in
   pieces of up to ``PIECE`` consecutive windows, dealt by the bytes that all windows
   of a piece contain, so the windows of a frequent anchor are spread by what is
   around it.

What a pack of documents asks, it asks once for each different context, so a passage
that fills a third of the corpus costs an entry a pack. Equality of windows is that
of their bytes. Copies of a whole context are recognised by a digest of its bytes (128
bits of BLAKE2b). Other hashes only pick anchors and deal suffixes to parts.

Defined results: null counts as empty (nothing to remove); repeated rows are two
occurrences, so both lose what they share; texts shorter than the threshold lose
nothing; an empty table gives an empty result; a null doc_id stays null; columns of
other names are never looked at; a very long text is packed alone and read in steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, written
from .packs import digit, n_parts, packed, texts_in, with_rows
from .repeats import contexts, covered

LENGTH, ANCHOR = 200, 64
#: Windows of a piece, and bytes of a digit.
PIECE, DIGIT = 16, 8
#: What a context is: all of its anchor are alike; it comes again, and here asks for all; it comes again, elsewhere asks; it comes once, as others of its anchor do.
ALIKE, SPEAKS, SILENT, ONCE = 1, 2, 3, 4


def byte_symbols(text: bytes) -> np.ndarray:
    return np.frombuffer(text, np.uint8)


def radix_groups(data: np.ndarray, at: np.ndarray, depth: int, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The strings data[at : at + depth] that are in a group of total weight 2 and more: their numbers, group after group, and the group of each.

    One pass a digit, the most significant first. A group of one (of weight 1)
    retires; a pass moves only members of groups that its digit parts.
    """
    alive, group = np.arange(len(at)), np.zeros(len(at), np.int64)
    width = min(DIGIT, depth)
    for begin in [*range(0, depth - width, width), depth - width]:
        if not len(alive):
            break
        # The digits of the alive strings; the last overlaps the one before it.
        keys = np.zeros(len(alive), np.uint64)
        for i in range(width):
            keys = keys << np.uint64(8) | data[at[alive] + (begin + i)].astype(np.uint64)
        alike = np.zeros(len(alive), bool)
        alike[1:] = (group[1:] == group[:-1]) & (keys[1:] == keys[:-1])
        heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        parted = np.add.reduceat(~alike, heads) > 1
        if parted.any():
            moved = np.flatnonzero(np.repeat(parted, np.diff(np.append(heads, len(alive)))))
            order = moved[np.lexsort((keys[moved], group[moved]))]
            alive[moved], keys[moved] = alive[order], keys[order]
            alike[1:] = (group[1:] == group[:-1]) & (keys[1:] == keys[:-1])
        alike[0] = False
        group = np.cumsum(~alike) - 1
        stay = np.bincount(group, weight[alive]) > 1
        if not stay.all():
            kept = stay[group]
            alive, group = alive[kept], (np.cumsum(stay) - 1)[group[kept]]
    return alive, group


class Pack:
    """The texts of a pack, end to end, and its contexts; of contexts with the same bytes the first stands for all."""

    def __init__(self, row: dict, length: int, k: int):
        self.texts = texts_in(row)
        self.body = b"".join(self.texts)
        self.length = length
        begins = np.cumsum([0, *map(len, self.texts)])[:-1].astype(np.int64)
        found = contexts([byte_symbols(t) for t in self.texts], length, k)
        shift = begins[found.text]
        self.first, self.last, self.at, self.anchor = found.first + shift, found.last + shift, found.at + shift, found.anchor
        seen: dict[bytes, int] = {}
        which, body = [], self.body
        for a, b, c in zip(self.first.tolist(), (self.last + length).tolist(), (self.at - self.first).tolist(), strict=True):
            which.append(seen.setdefault(hashlib.blake2b(body[a:b], digest_size=16, salt=c.to_bytes(8, "little")).digest(), len(seen)))
        #: The number of each context among the different ones; of these, the digests, one example each and how many there are.
        self.which = np.array(which, np.int64)
        self.digests = list(seen)
        _, self.example, self.counts = np.unique(self.which, return_index=True, return_counts=True)

    def dealt(self, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different contexts by the parts of their anchors, these parts, and where each begins."""
        part = digit(self.anchor[self.example], parts)
        order = np.argsort(part, kind="stable")
        numbers, begins = np.unique(part[order], return_index=True)
        return order, numbers, begins

    def statuses(self, replies: pa.Table, parts: int) -> np.ndarray:
        """The status of each different context; 0 where no reply speaks of it."""
        order, numbers, begins = self.dealt(parts)
        ends = dict(zip(numbers.tolist(), zip(begins.tolist(), [*begins[1:].tolist(), len(order)], strict=True), strict=True))
        status = np.zeros(len(order), np.uint8)
        for part, data in zip(replies.column("part").to_pylist(), replies.column("data").to_pylist(), strict=True):
            a, b = ends[part]
            status[order[a:b]] = np.frombuffer(data, np.uint8)
        return status

    def pieces(self, status: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the different contexts that speak or come once: context, first window, number of windows and place of the common bytes of each piece.

        Pieces begin at multiples of PIECE in the distance of a window from its anchor.
        """
        chosen = np.flatnonzero((status == SPEAKS) | (status == ONCE))
        e = self.example[chosen]
        low, high = (self.at[e] - self.last[e]) // PIECE, (self.at[e] - self.first[e]) // PIECE
        sizes = high - low + 1
        block = np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        context = np.repeat(chosen, sizes)
        e = self.example[context]
        first = np.maximum(self.first[e], self.at[e] - block * PIECE - (PIECE - 1))
        last = np.minimum(self.last[e], self.at[e] - block * PIECE)
        return context, first, last - first + 1, self.at[e] - block * PIECE


_BLOB = pa.schema([("part", pa.int32()), ("pack", pa.int64()), ("data", pa.binary())])
BLOB_SCHEMA = "part int, pack long, data binary"


def _blobs(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _BLOB.types, strict=True)], schema=_BLOB)


def _bytes_of(body: bytes, starts, ends) -> bytes:
    return b"".join([body[a:b] for a, b in zip(starts, ends, strict=True)])


def _ask_anchors(length: int, k: int, parts: int):
    """For each part: anchors as they are, digests of their contexts, and whether the pack has a context more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdCompressor

        squeeze = ZstdCompressor(level=1).compress
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                pack = Pack(row, length, k)
                order, numbers, begins = pack.dealt(parts)
                rows = []
                for number, a, b in zip(numbers.tolist(), begins.tolist(), [*begins[1:].tolist(), len(order)], strict=True):
                    own = order[a:b]
                    at = pack.at[pack.example[own]]
                    data = _bytes_of(pack.body, at.tolist(), (at + k).tolist()) + b"".join([pack.digests[x] for x in own.tolist()]) + (pack.counts[own] > 1).astype(np.uint8).tobytes()
                    rows.append((number, row["pack"], squeeze(data)))
                if rows:
                    yield _blobs(rows)

    return run


def _answer_anchors(k: int) -> Callable[[pa.Table], pa.Table]:
    """The first sort, of one part: the status of every context that was asked about."""

    def run(table: pa.Table) -> pa.Table:
        from zstandard import ZstdDecompressor

        expand = ZstdDecompressor().decompress
        blobs = [np.frombuffer(expand(x), np.uint8) for x in table.column("data").to_pylist()]
        sizes = np.array([len(b) // (k + 17) for b in blobs], np.int64)
        anchors = np.concatenate([b[: n * k] for b, n in zip(blobs, sizes, strict=True)])
        digests = np.concatenate([b[n * k : n * (k + 16)] for b, n in zip(blobs, sizes, strict=True)]).view(">u8").reshape(-1, 2)
        count = 1 + np.concatenate([b[n * (k + 16) :] for b, n in zip(blobs, sizes, strict=True)]).astype(np.int64)
        alive, group = radix_groups(anchors, np.arange(len(count)) * k, k, count)
        status = np.zeros(len(count), np.uint8)
        if len(alive):
            order = np.lexsort((digests[alive, 1], digests[alive, 0], group))
            alive, group = alive[order], group[order]
            own = digests[alive]
            new = np.ones(len(alive), bool)
            new[1:] = (group[1:] != group[:-1]) | (own[1:] != own[:-1]).any(axis=1)
            kind = np.cumsum(new) - 1
            kinds, copies = np.bincount(group, new)[group], np.bincount(kind, count[alive])[kind]
            status[alive] = np.where(kinds < 2, ALIKE, np.where(copies < 2, ONCE, np.where(new, SPEAKS, SILENT)))
        ends = np.cumsum(sizes).tolist()
        found = [status[e - n : e].tobytes() for e, n in zip(ends, sizes.tolist(), strict=True)]
        return pa.Table.from_arrays([table.column("part"), table.column("pack"), pa.array(found, pa.binary())], schema=_BLOB).filter(pa.array([any(x) for x in found]))

    return run


def _ask_windows(length: int, k: int):
    """The pieces of contexts that share their anchor with others: number, windows, whether it is known to come again, and the bytes."""

    def work(row: dict, replies: pa.Table) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest
        from zstandard import ZstdCompressor

        if not replies.num_rows:
            return
        squeeze = ZstdCompressor(level=1).compress
        pack = Pack(row, length, k)
        status = pack.statuses(replies, row["parts"])
        context, first, n, common = pack.pieces(status)
        if not len(context):
            return
        body, core = pack.body, length - PIECE + 1
        # Lengths under that of a piece have no common bytes; then the anchor deals.
        keys = np.array([xxh3_64_intdigest(body[c : c + core]) for c in common.tolist()], np.uint64) if core > 0 else pack.anchor[pack.example[context]]
        part = digit(keys, row["parts"])
        order = np.argsort(part, kind="stable")
        numbers, begins = np.unique(part[order], return_index=True)
        rows = []
        for number, a, b in zip(numbers.tolist(), begins.tolist(), [*begins[1:].tolist(), len(order)], strict=True):
            own = order[a:b]
            head = own.astype("<u4").tobytes() + n[own].astype(np.uint8).tobytes() + (status[context[own]] == SPEAKS).astype(np.uint8).tobytes()
            data = _bytes_of(body, first[own].tolist(), (first[own] + n[own] + length - 1).tolist())
            rows.append((number, row["pack"], squeeze(len(own).to_bytes(4, "little") + head + data)))
        yield _blobs(rows)

    return work


def _answer_windows(length: int) -> Callable[[pa.Table], pa.Table]:
    """The second sort, of one part: for each pack the pieces with repeated windows that weren't known, and which these are."""

    def run(table: pa.Table) -> pa.Table:
        from zstandard import ZstdDecompressor

        expand = ZstdDecompressor().decompress
        blobs = [expand(x) for x in table.column("data").to_pylist()]
        sizes = [int.from_bytes(b[:4], "little") for b in blobs]
        ids = np.concatenate([np.frombuffer(b, "<u4", n, 4) for b, n in zip(blobs, sizes, strict=True)])
        counts = np.concatenate([np.frombuffer(b, np.uint8, n, 4 + 4 * n) for b, n in zip(blobs, sizes, strict=True)]).astype(np.int64)
        known = np.concatenate([np.frombuffer(b, np.uint8, n, 4 + 5 * n) for b, n in zip(blobs, sizes, strict=True)])
        data = np.frombuffer(b"".join([b[4 + 6 * n :] for b, n in zip(blobs, sizes, strict=True)]), np.uint8)
        spans = counts + length - 1
        begins = np.cumsum(spans) - spans
        piece = np.repeat(np.arange(len(counts)), counts)
        within = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
        again, _ = radix_groups(data, begins[piece] + within, length, 1 + known[piece].astype(np.int64))
        again = again[known[piece[again]] == 0]
        masks = np.zeros(len(counts), np.uint32)
        np.bitwise_or.at(masks, piece[again], np.uint32(1) << within[again].astype(np.uint32))
        ends = np.cumsum(sizes).tolist()
        found = []
        for e, n in zip(ends, sizes, strict=True):
            own = e - n + np.flatnonzero(masks[e - n : e])
            found.append(ids[own].astype("<u4").tobytes() + masks[own].astype("<u2").tobytes())
        return pa.Table.from_arrays([table.column("part"), table.column("pack"), pa.array(found, pa.binary())], schema=_BLOB).filter(pa.array([len(x) > 0 for x in found]))

    return run


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
RESULT_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(doc_id, text: bytes, gone: np.ndarray) -> tuple:
    if not gone.any():
        return doc_id, len(text), 0, 0, hashlib.sha256(text).hexdigest()
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return doc_id, len(text), int(gone.sum()), spans, hashlib.sha256(byte_symbols(text)[~gone].tobytes()).hexdigest()


def _removed(length: int, k: int):
    """What is left of each document of a pack."""

    def work(row: dict, replies: pa.Table) -> Iterator[pa.RecordBatch]:
        about_windows = np.array(replies.column("windows").to_pylist(), bool)
        if len(about_windows):
            pack = Pack(row, length, k)
            texts = pack.texts
            status = pack.statuses(replies.filter(pa.array(~about_windows)), row["parts"])
            sure = np.flatnonzero(np.isin(status, (ALIKE, SPEAKS, SILENT))[pack.which])
            first, last = [pack.first[sure]], [pack.last[sure]]
            _, begins, _, _ = pack.pieces(status)
            for data in replies.filter(pa.array(about_windows)).column("data").to_pylist():
                n = len(data) // 6
                at, masks = begins[np.frombuffer(data, "<u4", n)], np.frombuffer(data, "<u2", n, 4 * n)
                for bit in range(PIECE):
                    hit = at[masks >> bit & 1 == 1] + bit
                    first.append(hit)
                    last.append(hit)
            gone = covered(len(pack.body), np.concatenate(first), np.concatenate(last), length)
        else:
            texts = texts_in(row)
            gone = np.zeros(sum(map(len, texts)), bool)
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64).tolist()
        rows = [_cut(doc, t, gone[e - len(t) : e]) for doc, t, e in zip(row["doc_ids"], texts, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _RESULT.types, strict=True)], schema=_RESULT)

    return work


def suffix_dedup(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of docs; doc_id is an integer. anchor: bytes of an anchor, length at most."""
    ship(docs.sparkSession)
    packs = packed(docs, key, text)
    parts = n_parts(packs)
    with_parts = packs.withColumn("parts", F.lit(parts))
    anchors = packs.mapInArrow(_ask_anchors(length, anchor, parts), BLOB_SCHEMA).groupBy("part").applyInArrow(_answer_anchors(anchor), BLOB_SCHEMA)
    anchors = written(anchors, "anchors")
    windows = with_rows(with_parts, anchors, _ask_windows(length, anchor), _BLOB, BLOB_SCHEMA).groupBy("part").applyInArrow(_answer_windows(length), BLOB_SCHEMA)
    windows = written(windows, "windows")
    replies = anchors.withColumn("windows", F.lit(False)).unionByName(windows.withColumn("windows", F.lit(True)))
    return with_rows(with_parts, replies, _removed(length, anchor), _RESULT, RESULT_SCHEMA)
