"""Operator 6, near-duplicates: b-bit MinHash, then links confirmed on the full shingle sets.

1. Every document gets its set of word shingles as 128-bit hashes, from them
   ``PERMS`` minima, from these ``BANDS`` band keys and a signature of the lowest
   ``BITS`` bits of each minimum.
2. Documents with the same set (a 128-bit digest of all its hashes) are one class;
   only its smallest doc_id goes on.
3. Classes that share a band key are tied to the smallest class of that bucket (a
   tie for each member, never pairs). Tied classes form a family.
4. Families are cut by hash into chunks of bounded size. First every chunk meets
   itself and its family's first chunk, which links a hot family in a number of
   steps that grows with it. In families of more chunks, only the buckets that still
   hold several components go on: they make families anew, and all chunks of these
   meet, unless both hold the same single component. In a meeting the signatures are compared by bit counts,
   corrected for chance agreement of b bits; pairs that may be similar and are not
   connected yet are confirmed on the full sets, by the first 64 bits of each hash.
5. Links give components.

A pair of similarity 0.75 shares no band with probability (1 - 0.75^4)^32 = 5e-6;
it's missed then only if no chain of other documents ties both into one family. The
estimate drops pairs below ``FLOOR``, five standard errors under the threshold.

Defined results: null, empty and wordless texts have the empty set and are linked
with nothing; a row whose doc_id is null is returned with itself (null) as its
component and not compared; repeated rows are linked with each other; an empty
table gives an empty result; columns of other names are never looked at; a very long
text is one set, hashed in steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import backquoted, listed, ship, tidied, written
from .components import Forest, components

SHINGLE, THRESHOLD = 5, 75
BANDS, ROWS, BITS = 32, 4, 4
PERMS = BANDS * ROWS
FLOOR = 0.55
#: Bytes of shingle hashes in a chunk of a family.
CHUNK_BYTES = 250_000
#: Words that are hashed at once.
STEP = 1 << 16

# Bytes: A-Z lowered, the characters between words as spaces.
_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if b in (0x20, *range(9, 14)) else b for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SALTS = _mix(np.arange(1, PERMS + 1, dtype=np.uint64) * _BASE)


def _word_hashes(parts: list[bytes]) -> np.ndarray:
    """128-bit hashes of words, as two columns."""
    from xxhash import xxh3_128_digest

    return np.frombuffer(b"".join(map(xxh3_128_digest, parts)), np.uint64).reshape(-1, 2)


def shingles(text: str) -> np.ndarray:
    """The distinct shingles of a text as 128-bit hashes: two columns, sorted."""
    parts = text.encode("utf-8", "surrogatepass").translate(_WORDS).split()
    if not parts:
        return np.zeros((0, 2), np.uint64)
    hashes = np.concatenate([_word_hashes(parts[i : i + STEP]) for i in range(0, len(parts), STEP)])
    size = min(SHINGLE, len(parts))
    n = len(parts) - size + 1
    one, two = (_combine([hashes[i : n + i, lane] for i in range(size)]) for lane in (0, 1))
    order = np.argsort(one)
    one, two = one[order], two[order]
    new = np.ones(n, bool)
    new[1:] = one[1:] != one[:-1]
    if (~new & np.concatenate([[False], two[1:] != two[:-1]])).any():
        # Different shingles of one first column: they are told apart by the second.
        return np.unique(np.stack([one, two], axis=1), axis=0)
    return np.stack([one[new], two[new]], axis=1)


def _combine(columns: list[np.ndarray]) -> np.ndarray:
    """A hash of each row; every step is mixed, so no pattern of rows cancels out."""
    out = np.full(len(columns[0]), len(columns), np.uint64)
    for c in columns:
        out = _mix(out * _BASE + c)
    return out


def minima(hashes: np.ndarray) -> np.ndarray:
    """The minimum of each salted order of a set of 64-bit hashes, in steps of bounded memory."""
    best = np.full(PERMS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 512):
        part = hashes[i : i + 512, None] ^ _SALTS
        part *= np.uint64(0xD6E8FEB86659FD93)
        part ^= part >> np.uint64(32)
        part *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum(best, part.min(axis=0), out=best)
    return best


def band_keys(best: np.ndarray) -> np.ndarray:
    rows = best.reshape(BANDS, ROWS)
    return _combine([np.arange(BANDS, dtype=np.uint64), *[rows[:, r] for r in range(ROWS)]])


def packed(best: np.ndarray) -> bytes:
    """The low bits of each minimum, one bit plane after the other."""
    low = _mix(best) & np.uint64((1 << BITS) - 1)
    planes = [np.packbits(((low >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)) for b in range(BITS)]
    return np.concatenate(planes).tobytes()


def similarity(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Estimated similarity of a signature to others: agreement of all bits, without what chance gives."""
    differ = np.bitwise_or.reduce((one ^ many).reshape(len(many), BITS, -1), axis=1)
    agree = 1 - np.bitwise_count(differ).sum(axis=1) / PERMS
    chance = 1 / (1 << BITS)
    return (agree - chance) / (1 - chance)


_SIGNED = "doc_id long, tie long, set_key binary, n_shingles long, bands array<long>, signature binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from hashlib import blake2b

    for batch in batches:
        keys, sizes, bands, signatures = [], [], [], []
        for text in batch.column("text"):
            found = shingles(text.as_py() or "")
            sizes.append(len(found))
            keys.append(blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
            best = minima(found[:, 0]) if len(found) else None
            bands.append(band_keys(best).view(np.int64) if len(found) else [])
            signatures.append(packed(best) if len(found) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("tie"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(signatures, pa.binary())],
            names=["doc_id", "tie", "set_key", "n_shingles", "bands", "signature"],
        )


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(text.as_py() or "")[:, 0].tobytes() for text in batch.column("text")]
        rest = [batch.column(n) for n in ("family", "n_chunks", "doc_id", "signature")]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(sets, pa.binary())], names=["family", "n_chunks", "doc_id", "signature", "shingles"])


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the threshold."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < THRESHOLD * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= THRESHOLD * (len(a) + len(b) - both)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows are meetings of two chunks (or one with itself: the second is null); yields links that span what is connected in each."""
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            members, other = row["one"], row["two"] or []
            everyone = members + other
            ids = [m["doc_id"] for m in everyone]
            sets = [np.frombuffer(m["shingles"], np.uint64) for m in everyone]
            signatures = np.frombuffer(b"".join(m["signature"] for m in everyone), np.uint8).reshape(len(everyone), -1)
            forest, links = Forest(), []
            if row["known"]:
                for m in everyone:
                    forest.unite(m["doc_id"], m["component"])
            for i in range(len(members)):
                # A chunk meets itself below its diagonal, another chunk in whole.
                low = len(members) if other else i + 1
                near = similarity(signatures[i], signatures[low:]) if low < len(everyone) else np.zeros(0)
                close = np.flatnonzero(near >= FLOOR)
                for j in (low + close[np.argsort(-near[close], kind="stable")]).tolist():
                    if forest.root(ids[i]) != forest.root(ids[j]) and _similar(sets[i], sets[j]):
                        forest.unite(ids[i], ids[j])
                        links.append((ids[i], ids[j]))
            if links:
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _chunked(members: DataFrame) -> DataFrame:
    """One row a chunk: family, chunk and its members."""
    return members.groupBy("family", "n_chunks", "chunk").agg(F.collect_list(F.struct("doc_id", "signature", "shingles", "component")).alias("members"))


def _meetings(chunks: DataFrame, partners, known: bool) -> DataFrame:
    """Links found where chunks meet those of their families that ``partners`` (an array of chunk numbers) names."""
    ones = chunks.select("family", F.explode(partners).alias("chunk"), F.col("members").alias("one"))
    twos = chunks.select("family", "chunk", F.col("members").alias("two"))
    met = ones.join(twos, ["family", "chunk"]).select("one", "two", F.lit(known).alias("known"))
    return met.mapInArrow(tidied(_meet), "a long, b long")


def near_links(reps: DataFrame, texts: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of classes that reach the threshold.

    reps: doc_id, tie, n_shingles, bands and signature of each class; texts: doc_id, tie, text.
    """
    keyed = reps.select(F.explode("bands").alias("band"), "doc_id")
    hubs = written(keyed.groupBy("band").agg(F.min("doc_id").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "hub"), "hubs")
    ties = keyed.join(hubs, "band").where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct()
    families = components(ties).withColumnsRenamed({"node": "doc_id", "component": "family"})
    placed = written(families.join(reps.select("doc_id", "tie", "n_shingles", "signature"), "doc_id"), "placed")
    sizes = written(placed.groupBy("family").agg(F.ceil(F.sum(F.col("n_shingles") * 8 + 96) / chunk_bytes).cast("int").alias("n_chunks")), "sizes")
    # Texts outside of families stay where they are, as long as the list of those inside is small.
    texts = texts.join(listed(placed.select("doc_id", "tie")), ["doc_id", "tie"], "left_semi")
    members = placed.join(sizes, "family").select("family", "n_chunks", "doc_id", "tie", "signature").join(texts.dropDuplicates(["doc_id", "tie"]), ["doc_id", "tie"])
    with_sets = members.select("family", "n_chunks", "doc_id", "signature", "text").mapInArrow(tidied(_with_sets), "family long, n_chunks int, doc_id long, signature binary, shingles binary")
    numbered = with_sets.withColumn("component", F.col("doc_id")).withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("n_chunks")).cast("int"))
    chunks = written(_chunked(numbered), "chunks")
    # As many meetings as chunks: each with itself, and a family's first with its others.
    alone = chunks.select(F.col("members").alias("one"), F.lit(None).cast(chunks.schema["members"].dataType).alias("two"), F.lit(False).alias("known"))
    # A family's first chunk comes once to the join; where it meets many others, adaptive execution splits these.
    several = chunks.where("n_chunks > 1")
    firsts, others = (several.where(c).select("family", F.col("members").alias(n)) for c, n in (("chunk = 0", "one"), ("chunk > 0", "two")))
    met = others.join(firsts, "family").select("one", "two", F.lit(False).alias("known"))
    links = written(alone.mapInArrow(tidied(_meet), "a long, b long").unionByName(met.mapInArrow(tidied(_meet), "a long, b long")), "first_links")
    several = chunks.where("n_chunks > 2")
    if several.isEmpty():
        return links
    # From here on the buckets that still hold several components make the families: what shares none but settled ones is done.
    apart = several.select(F.explode("members").alias("m")).select("m.doc_id", "m.signature", "m.shingles")
    apart = apart.join(components(links).select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    apart = written(apart.withColumn("component", F.coalesce("component", "doc_id")), "apart")
    # Joined by document, before the bands are rows: they move once, to their buckets.
    found = written(apart.select("doc_id", "component").distinct(), "ids_apart")
    keyed = written(reps.select("doc_id", "bands").join(listed(found), "doc_id"), "bands_apart").select(F.explode("bands").alias("band"), "doc_id", "component")
    unsettled = written(keyed.groupBy("band").agg(F.min("doc_id").alias("hub"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band", "hub"), "unsettled")
    ties = keyed.join(unsettled, "band").where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct()
    families = components(ties).withColumnsRenamed({"node": "doc_id", "component": "family"})
    apart = written(apart.join(families, "doc_id"), "asked")
    sizes = apart.groupBy("family").agg(F.ceil(F.sum(F.octet_length("shingles") + 96) / chunk_bytes).cast("int").alias("n_chunks"))
    counted = apart.groupBy("family", "component").agg(F.count(F.lit(1)).alias("n"))
    main = counted.groupBy("family").agg(F.max(F.struct("n", "component"))["component"].alias("main"))
    half = (F.col("component") != F.col("main")).cast("int")
    apart = apart.join(written(sizes.join(main, "family"), "main"), "family").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("n_chunks")).cast("int") * 2 + half)
    chunks = written(_chunked(apart), "chunks_apart")
    # 2c holds what the family's largest component has in chunk c, which meets none of its own; 2c + 1 holds the rest.
    c = F.col("chunk")
    alone = chunks.where(c % 2 == 1).select(F.col("members").alias("one"), F.lit(None).cast(chunks.schema["members"].dataType).alias("two"), F.lit(True).alias("known"))
    rest = F.filter(F.sequence(F.lit(0), F.col("n_chunks") * 2 - 1), lambda j: (j % 2 == 0) | (j > c))
    partners = F.when(c % 2 == 1, rest).otherwise(F.array().cast("array<int>"))
    return links.unionByName(written(alone.mapInArrow(tidied(_meet), "a long, b long").unionByName(_meetings(chunks, partners, True)), "later_links"))


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs; doc_id is an integer."""
    ship(docs.sparkSession)
    source = docs.select(F.col(backquoted(key)).cast("long").alias("doc_id"), F.col(backquoted(text)).alias("text")).withColumn("tie", F.xxhash64("text"))
    signed = written(source.mapInArrow(tidied(_sign), _SIGNED), "signed")
    named = signed.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
    # A class: the rows of equal sets.
    classes = written(named.groupBy("set_key").agg(F.min(F.struct("doc_id", "tie", "n_shingles", "bands", "signature")).alias("r")).select("set_key", "r.*"), "classes")
    links = near_links(classes.drop("set_key"), source, chunk_bytes)
    # Rows of one doc_id are one document of the graph, also when their sets differ.
    ids = named.select("doc_id", "set_key").join(classes.select("set_key", F.col("doc_id").alias("rep")), "set_key").where("doc_id <> rep")
    found = components(links.unionByName(ids.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))))
    out = signed.select("doc_id", "n_shingles").join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )
