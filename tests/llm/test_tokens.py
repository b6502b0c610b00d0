"""Token counts, token files: against the tokenizers library on whole texts."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from basalt.llm.token_counts import spliced_ids, token_counts
from basalt.llm.token_files import DacFile, encode_dac, read_token_files, write_token_files
from basalt.llm.units import UnitEncoder

BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, ids string, tie long"
ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n\n a\t b", "it's we'll 're", "x<|endoftext|>y <|endoftext|>", "äöü ß ñ 漢字 かな 🙂🙂",
    "12 345 6789", "a  b  c  d", "\x1c a \x85 b", "  lead and trail  ", "don't 'S 'LL", "!!! ??? ...", "a​ b", "　 　x",
]


def mixed(n: int, seed: int) -> str:
    r = random.Random(seed)
    return "".join(r.choice([*ODD, "word", " the", "'", "r", "e", "\n", "<|endo", "ftext|>", "7"]) for _ in range(n))


@pytest.fixture(scope="module")
def bpe():
    return Tokenizer.from_file(BPE)


def plain(bpe, text):
    return bpe.encode(text, add_special_tokens=False).ids


def test_units_encode_as_the_whole(bpe):
    encoder = UnitEncoder(BPE, list)
    for text in [*ODD, *[mixed(40, s) for s in range(300)]]:
        assert sum(encoder.values(text), []) == plain(bpe, text), repr(text)


@pytest.mark.parametrize(("chunk", "overlap"), [(200, 80), (300, 3), (97, 70)])
def test_splices_are_exact(bpe, chunk, overlap):
    texts = [mixed(300, s) for s in range(30)] + ["a" * 900, " " * 700, "x\n" * 500, "<|endoftext|>" * 90, "'re" * 300]
    for text in texts:
        assert sum(spliced_ids(bpe, text, chunk, overlap), []) == plain(bpe, text), repr(text[:80])


def rows(extra=()):
    texts = [None, *ODD, mixed(9000, 1), *extra]
    out = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    return [*out, out[3], (3, "other text", "x", 2), (None, "no id", "x", 2)]


def test_token_counts(spark, bpe):
    data = rows()
    got = sorted(map(tuple, token_counts(spark.createDataFrame(data, SCHEMA), BPE, limit=3).collect()), key=str)
    want = [(i, len((t or "").encode()), n := len(plain(bpe, t or "")), n > 3) for i, t, *_ in data]
    assert got == sorted(want, key=str)
    assert token_counts(spark.createDataFrame([], SCHEMA), BPE).collect() == []


def test_dac_round_trip():
    r = np.random.default_rng(0)
    for ids in (np.zeros(0, np.uint32), r.integers(0, 300, 5000), r.integers(0, 1 << 31, 3000), r.integers(0, 50257, 1537)):
        data = encode_dac(np.array([7]), np.array([0, len(ids)]), ids.astype(np.uint32))
        found = DacFile(data)
        assert found.n_tokens == len(ids) and found.tokens(0, len(ids)).tolist() == ids.tolist()
        for i in r.integers(0, max(len(ids), 1), 50 if len(ids) else 0).tolist():
            assert found.token(i) == ids[i]
            assert found.tokens(i, min(i + 700, len(ids))).tolist() == ids[i : i + 700].tolist()
    with pytest.raises(ValueError):
        DacFile(b"otherwise" * 9)


@pytest.mark.parametrize("file_tokens", [50, 4_000_000])
def test_token_files(spark, bpe, file_tokens):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = sorted(map(tuple, read_token_files(write_token_files(docs, BPE, file_tokens=file_tokens)).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((d[0] for d in data), key=lambda k: (k is not None, k))
    start, texts = 0, {}
    for i, t, *_ in data:
        texts.setdefault(i, []).append(plain(bpe, t or "") + [0])
    for i, at, n, crc in got:
        ids = next(x for x in texts[i] if len(x) == n and zlib.crc32(np.array(x, "<u4").tobytes()) == crc)
        texts[i].remove(ids)
        assert at == start
        start += n
    assert not any(texts.values())
    empty = write_token_files(spark.createDataFrame([], SCHEMA), BPE)
    assert read_token_files(empty).collect() == []
