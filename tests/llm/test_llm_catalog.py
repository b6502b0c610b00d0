"""The queries with SQL against it, and the others against brute force, on whole small tables."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from basalt.llm import catalog
from tests.llm.test_repeats import brute_bytes
from tests.llm.test_texts import MODEL, brute_base
from tests.oracle import SF, from_spark, from_sql


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, name):
    got = from_spark(catalog.queries()[name](spark, SF))
    names, want = from_sql(catalog.oracle_sql()[name])
    assert got[0] == names
    assert not got[1] - want and not want - got[1]


@pytest.fixture(scope="module")
def documents():
    return sorted((r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist())


def test_tokens(spark, documents):
    bpe = Tokenizer.from_file(catalog.BPE)
    ids = {i: bpe.encode(t, add_special_tokens=False).ids for i, t in documents}
    counts = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in catalog.op1_token_counts(spark, SF).collect()}
    assert counts == {i: (len(t.encode()), len(ids[i]), len(ids[i]) > 1024) for i, t in documents}
    files = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in catalog.op7_token_files(spark, SF).collect()}
    start, want = 0, {}
    for i, _ in documents:
        own = [*ids[i], 0]
        want[i] = (start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        start += len(own)
    assert files == want


def test_pieces(spark, documents):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r.doc_id: (r.n_pieces, r.ids_crc32, r.round_trip) for r in catalog.op2_piece_codec(spark, SF).collect()}
    for i, t in documents:
        ids = library.encode(t)
        assert got[i] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), library.decode(ids) == t)


def test_secrets(spark, documents):
    got = {r.doc_id: (r.base_sha256, r.spans) for r in catalog.op5_secret_scan(spark, SF).collect()}
    for i, t in documents:
        want = ",".join(f"{k}:{a}:{b}" for a, b, k in brute_base(t))
        assert got[i][0] == hashlib.sha256(want.encode()).hexdigest()
        assert re.sub(r"(^|,)novel:\d+:\d+", "", got[i][1]).strip(",") == want


def test_suffixes(spark, documents):
    got = sorted(map(tuple, catalog.op4_suffix_dedup(spark, SF).collect()))
    assert got == sorted(brute_bytes(documents, 200))
