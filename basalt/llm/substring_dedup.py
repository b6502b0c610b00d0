"""Operator 8, substring dedup: a de Bruijn graph of word k-mers, compacted by Spark joins.

Edges are the k-mers of words, with k the window's length, so an edge that has two
places is a repeated window. Nodes are what two edges that follow each other share.

1. Every edge is counted, by 39 bits of its hash: edges with one place fall out. What
   is left of a document are runs of candidate edges, its *paths*.
2. Paths are grouped by a digest of their words. A path that is the same in many
   places goes on once, with its number of places, so a passage in a third of the
   corpus is one path.
3. The edges of the different paths, by 128 bits, are grouped: at an edge whose
   places have different edges before or behind them, the graph *branches*. Joined to
   the branching edges, each path is cut there: what lies between two cuts is a
   nonbranching path, compacted to one row.
4. Compacted paths are grouped by a digest of their words, read at their source
   coordinates. Two places and more prove a span repeated, word by word. A compacted
   path that this doesn't prove (hashes of different words that agree) is taken apart
   into its edges, which are proved in the same way.
5. Each document loses the words of proved spans; a path that was counted as a whole
   passes its spans on to all its places.

Digests are 128 bits of BLAKE2b over the words themselves; hashes only pick and deal
candidates. The polynomials of other versions aren't used: windows are hashed by
mixing halves, which no pattern of words cancels out.

Defined results: null and wordless texts have no words; repeated rows are two
occurrences, so both lose what they share; texts shorter than the threshold lose
nothing; an empty table gives an empty result; a null doc_id stays null; columns of
other names are never looked at; a very long text is packed alone and worked on in
arrays of some 60 bytes a word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import listed, ship, written
from .packs import n_parts, packed, split_counts, texts_in, with_rows
from .repeats import covered, mix

LENGTH = 35
#: Bytes of all texts for each part that edges are counted in.
PART_BYTES = 16_000_000

# Bytes: the characters between words as spaces.
_SPACES = bytes(0x20 if b in (0x20, *range(9, 14)) else b for b in range(256))
_U = np.uint64
#: Bits of an edge that are counted; the lowest says that the pack has it more than once.
_BITS = _U((1 << 40) - 2)
_STEP = 1 << 16


def split_words(text: bytes) -> list[bytes]:
    return text.translate(_SPACES).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """128-bit hashes of words, as two columns."""
    from xxhash import xxh3_128_digest

    parts = [np.frombuffer(b"".join(map(xxh3_128_digest, words[i : i + _STEP])), np.uint64).reshape(-1, 2) for i in range(0, len(words), _STEP)]
    return np.concatenate(parts) if parts else np.zeros((0, 2), np.uint64)


def window_hashes(column: np.ndarray, length: int, salt: int) -> np.ndarray:
    """A hash of every window: halves of doubled size are mixed, the last two overlapping."""
    h, size, salt = mix(column + _U(salt)), 1, _U(2 * salt + 0x9E3779B97F4A7C15)
    while size < length:
        step = min(size, length - size)
        if len(h) <= step:
            return np.zeros(0, np.uint64)
        h = mix(h[:-step] * salt + h[step:])
        size += step
    return h


class Words:
    """The words of a pack, end to end, and its edges."""

    def __init__(self, row: dict, length: int):
        self.texts = texts_in(row)
        self.length = length
        self.words: list[bytes] = []
        self.ends: list[int] = []
        for t in self.texts:
            self.words += split_words(t)
            self.ends.append(len(self.words))
        self.hashes = word_hashes(self.words)
        ends = np.array([0, *self.ends], np.int64)
        sizes = np.maximum(np.diff(ends) - length + 1, 0)
        #: Starts of the edges, those over the end of a document left out.
        self.starts = np.repeat(ends[:-1] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())

    def edges(self, lane: int) -> np.ndarray:
        return window_hashes(self.hashes[:, lane], self.length, lane + 1)[self.starts]

    def digest(self, start: int, edges: int) -> bytes:
        """Of the words of a path of so many edges."""
        return hashlib.blake2b(b" ".join(self.words[start : start + edges + self.length - 1]), digest_size=16).digest()


def _counted(pack: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different edges of a pack in order, the number of each edge among them, and whether it has it more than once."""
    found, which, counts = np.unique(pack.edges(0), return_inverse=True, return_counts=True)
    return found, which, counts > 1


_ASK = pa.schema([("part", pa.int32()), ("pack", pa.int64()), ("keys", pa.binary())])
_REPLY = pa.schema([("pack", pa.int64()), ("part", pa.int32()), ("bits", pa.binary())])


def _ask(length: int, parts: int):
    """Edges of 5 bytes each, dealt by their high bits; those of a pack are in order, so its reply needs no keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                edges, _, more = _counted(Words(row, length))
                short = ((edges & _BITS) | more.astype(np.uint64)).view(np.uint8).reshape(-1, 8)[:, :5]
                numbers, begins = split_counts(edges, parts)
                keys = [short[a:b].tobytes() for a, b in zip(begins, [*begins[1:], len(edges)], strict=True)]
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array([row["pack"]] * len(keys), pa.int64()), pa.array(keys, pa.binary())], schema=_ASK)

    return run


def _answer(table: pa.Table) -> pa.Table:
    """For each ask of a part, a bit an edge: whether it has two places and more."""
    blobs = table.column("keys").to_pylist()
    raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 5)
    keys = np.zeros((len(raw), 8), np.uint8)
    keys[:, :5] = raw
    keys = keys.view(np.uint64).ravel()
    order = np.argsort(keys >> _U(1), kind="stable")
    inside = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = inside[1:] >> _U(1) != inside[:-1] >> _U(1)
    group = np.cumsum(new) - 1
    twice = np.bincount(group, 1 + (inside & _U(1)).astype(np.int64)) > 1
    hit = np.zeros(len(keys), bool)
    hit[order] = twice[group]
    ends = np.cumsum([len(b) // 5 for b in blobs]).tolist()
    bits = [np.packbits(hit[e - len(b) // 5 : e]).tobytes() for e, b in zip(ends, blobs, strict=True)]
    return pa.Table.from_arrays([table.column("pack"), table.column("part"), pa.array(bits, pa.binary())], schema=_REPLY)


_PATH = pa.schema([("digest", pa.binary()), ("pack", pa.int64()), ("at", pa.int64()), ("edges", pa.int64())])


def _runs(flags: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and numbers of edges of the longest runs of flagged edges that follow each other."""
    at = starts[flags]
    if not len(at):
        return at, at
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + 1]))
    return at[first], np.diff(np.append(first, len(at)))


def _document_runs(pack: Words, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_runs within documents: starts of different documents never follow each other, as windows end with theirs."""
    return _runs(flags, pack.starts)


def _paths(length: int):
    def work(row: dict, replies: pa.Table) -> Iterator[pa.RecordBatch]:
        replies = sorted(zip(replies.column("part").to_pylist(), replies.column("bits").to_pylist(), strict=True))
        if not replies:
            return
        pack = Words(row, length)
        edges, which, _ = _counted(pack)
        _, begins = split_counts(edges, row["parts"])
        sizes = np.diff([*begins, len(edges)]).tolist()
        twice = np.concatenate([np.unpackbits(np.frombuffer(bits, np.uint8), count=n) for (_, bits), n in zip(replies, sizes, strict=True)]).astype(bool)
        at, n = _document_runs(pack, twice[which])
        digests = [pack.digest(a, b) for a, b in zip(at.tolist(), n.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([row["pack"]] * len(at), pa.int64()), pa.array(at), pa.array(n)], schema=_PATH)

    return work


_EDGE = pa.schema([("edge", pa.int64()), ("sides", pa.int32()), ("pack", pa.int64()), ("at", pa.int64())])


def _edges(length: int):
    """The edges of the paths that a pack speaks for: their hash, a hash of the words before and behind in the path, and their place."""

    def work(row: dict, own: pa.Table) -> Iterator[pa.RecordBatch]:
        if not own.num_rows:
            return
        pack = Words(row, length)
        keys = window_hashes(pack.hashes[:, 1], length, 2)
        words = pack.hashes[:, 0]
        for a, n in zip(own.column("at").to_pylist(), own.column("edges").to_pylist(), strict=True):
            before = np.concatenate([[0], words[a : a + n - 1]]).astype(np.uint64)
            behind = np.concatenate([words[a + length : a + length + n - 1], [0]]).astype(np.uint64)
            sides = (mix(mix(before) + behind) >> _U(32)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + n].view(np.int64)), pa.array(sides), pa.array(np.full(n, row["pack"])), pa.array(np.arange(a, a + n))], schema=_EDGE)

    return work


_COMPACT = pa.schema([("digest", pa.binary()), ("of", pa.binary()), ("offset", pa.int64()), ("edges", pa.int64()), ("places", pa.int64())])


def _compact(length: int):
    """The paths that a pack speaks for, cut before and behind their branching edges: one row for each part."""

    def work(row: dict, own: pa.Table) -> Iterator[pa.RecordBatch]:
        digests = own.column("digest").to_pylist()
        at, edges, places = (own.column(c).to_numpy() for c in ("at", "edges", "places"))
        spoken = np.flatnonzero(places > 0)
        if not len(spoken):
            return
        pack, cuts, out = Words(row, length), np.sort(at[places == 0]), []
        for i in spoken.tolist():
            a, n = int(at[i]), int(edges[i])
            inside = cuts[np.searchsorted(cuts, a) : np.searchsorted(cuts, a + n)]
            bounds = np.unique(np.concatenate([[a, a + n], inside, inside + 1])).tolist()
            out += [(pack.digest(b, e - b), digests[i], b - a, e - b, int(places[i])) for b, e in zip(bounds, bounds[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _COMPACT.types, strict=True)], schema=_COMPACT)

    return work


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def _removed(length: int):
    """What is left of each document of a pack: its paths go, without the parts that weren't proved."""

    def work(row: dict, own: pa.Table) -> Iterator[pa.RecordBatch]:
        at, edges, proved = (own.column(c).to_numpy(zero_copy_only=False) for c in ("at", "edges", "proved"))
        parts = [split_words(t) for t in texts_in(row)]
        ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        repeated = covered(total, at[proved], at[proved] + edges[proved] - 1, 1) if proved.any() else np.zeros(total, bool)
        for a, n in zip(at[~proved].tolist(), edges[~proved].tolist(), strict=True):
            repeated[a : a + n] = False
        starts = np.flatnonzero(repeated)
        gone = covered(total, starts, starts, length)
        rows = []
        for doc, words, end in zip(row["doc_ids"], parts, ends.tolist(), strict=True):
            mine = gone[end - len(words) : end]
            kept = [w for w, g in zip(words, mine.tolist(), strict=True) if not g] if mine.any() else words
            rows.append((doc, len(words), int(mine.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _RESULT.types, strict=True)], schema=_RESULT)

    return work


def compacted(packs: DataFrame, paths: DataFrame, length: int = LENGTH) -> DataFrame:
    """digest, path (``of``), offset, edges and places of each nonbranching part of each different path of ``paths`` (digest, pack, at, edges)."""
    place = F.min(F.struct("pack", "at")).alias("p")
    speakers = written(paths.groupBy("digest").agg(place, F.first("edges").alias("edges"), F.count(F.lit(1)).alias("places")).select("digest", "p.pack", "p.at", "edges", "places"), "speakers")
    edges = written(with_rows(packs, speakers, _edges(length), _EDGE, "edge long, sides int, pack long, at long"), "edges")
    branching = edges.groupBy("edge").agg(F.min("sides").alias("low"), F.max("sides").alias("high")).where("low <> high").select("edge")
    # Written, so that both sides of the join are exchanged alone and a hot edge's places can be split.
    cuts = edges.select("edge", "pack", "at").join(written(branching, "branching"), "edge")
    cuts = written(cuts.selectExpr("CAST(NULL AS BINARY) AS digest", "pack", "at", "1L AS edges", "0L AS places"), "cuts")
    return written(with_rows(packs, speakers.unionByName(cuts), _compact(length), _COMPACT, "digest binary, of binary, offset long, edges long, places long"), "compact")


def substring_dedup(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row of docs; doc_id is an integer."""
    ship(docs.sparkSession)
    packs = packed(docs, key, text)
    parts = n_parts(packs, PART_BYTES)
    counted = packs.mapInArrow(_ask(length, parts), "part int, pack long, keys binary").groupBy("part").applyInArrow(_answer, "pack long, part int, bits binary")
    candidates = with_rows(packs.withColumn("parts", F.lit(parts)), counted, _paths(length), _PATH, "digest binary, pack long, at long, edges long")
    paths = written(candidates, "paths")
    parts_of = compacted(packs, paths, length)
    alone = written(parts_of.groupBy("digest").agg(F.sum("places").alias("n")).where("n < 2").select("digest"), "alone")
    unproved = written(parts_of.join(listed(alone), "digest").select(F.col("of").alias("digest"), "offset", F.col("edges").alias("n")), "unproved")
    holes = paths.join(listed(unproved), "digest").selectExpr("pack", "at + offset AS at", "n AS edges", "false AS proved")
    own = paths.selectExpr("pack", "at", "edges", "true AS proved").unionByName(holes)
    return with_rows(packs, own, _removed(length), _RESULT, "doc_id long, n_words long, n_removed long, kept_sha256 string")
