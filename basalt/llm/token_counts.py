"""Operator 1, token counts: overlapping chunks of huge texts, spliced where both agree.

A text of up to ``CHUNK`` characters is one chunk. A longer one is encoded in
chunks that overlap, each with character offsets. A chunk is spliced to the one
before it at a position in the overlap where *both* begin a pre-token, far
enough from the earlier chunk's end that nothing beyond it could have changed
that. The pattern is memoryless from the start of a pre-token, so behind such a
position the later chunk has what the whole text has; no other position is
trusted. If the overlap has none, it is widened, up to the rest of the text.

Defined results: null counts as empty (0 bytes, 0 tokens); repeated rows are
counted one by one; an empty table gives an empty result; other columns are
never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import backquoted, ship, texts_of, tidied
from .units import UnitEncoder, tokenizer

#: Characters of a chunk, and of the first overlap of two chunks.
CHUNK, OVERLAP = 32_768, 512
#: Characters before a chunk's end that the missing rest could change: contractions
#: look two ahead, and a special token (13 characters at most here) may be cut.
MARGIN = 64


def _encoded(encoder, text: str, start: int) -> tuple[list[int], dict[int, int]]:
    """The ids of text, and the positions (plus start) at which a pre-token begins, with the index of its first token."""
    found = encoder.encode(text, add_special_tokens=False)
    words, offsets = found.word_ids, found.offsets
    begins = {}
    for i, (word, (at, _)) in enumerate(zip(words, offsets, strict=True)):
        if i == 0 or word is None or word != words[i - 1]:
            begins.setdefault(start + at, i)
    return found.ids, begins


def spliced_ids(encoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, margin: int = MARGIN) -> Iterator[list[int]]:
    """The ids of the whole text, in runs; their concatenation is encoder.encode(text).ids."""
    begin, end = 0, min(len(text), chunk)
    ids, begins = _encoded(encoder, text[:end], 0)
    first = 0  # token of this chunk at which its own part begins
    while end < len(text):
        wide = overlap
        while True:
            start, stop = max(end - wide, begin), min(len(text), end + chunk)
            if start <= begin:
                # The overlap holds the whole chunk: encode both as one, twice as long at least, so that all such encodings together stay in proportion.
                stop = min(len(text), max(stop, 2 * end - begin))
                ids, begins = _encoded(encoder, text[begin:stop], begin)
                end, first = stop, 0
                break
            later, later_begins = _encoded(encoder, text[start:stop], start)
            common = [b for b in begins if start < b <= end - margin and b in later_begins and begins[b] >= first]
            if common:
                b = max(common)
                yield ids[first : begins[b]]
                ids, begins, first = later, later_begins, later_begins[b]
                begin, end = b, stop
                break
            wide *= 4
    yield ids[first:]


def _counts(path: str, limit: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, cached = tokenizer(path), UnitEncoder(path, len)
        for batch in batches:
            n_tokens = [
                sum(cached.values(text)) if len(text) <= chunk else sum(map(len, spliced_ids(encoder, text, chunk)))
                for text in texts_of(batch.column("text"))
            ]
            n = pa.array(n_tokens, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), n, pa.array([x > limit for x in n_tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return run


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row of docs.

    tokenizer_path: a .json file of the tokenizers library with a byte-level
    pre-tokeniser, present on every executor.
    """
    ship(docs.sparkSession)
    t = F.col(backquoted(text))
    source = docs.select(F.col(backquoted(key)).alias("doc_id"), F.coalesce(F.octet_length(t), F.lit(0)).cast("long").alias("n_bytes"), t.alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(tidied(_counts(tokenizer_path, limit, chunk)), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
