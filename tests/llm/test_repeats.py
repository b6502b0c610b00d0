"""Suffix dedup and substring dedup against brute force over every window."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from basalt.llm.substring_dedup import split_words, substring_dedup
from basalt.llm.suffix_dedup import byte_symbols, radix_groups, suffix_dedup

SCHEMA = "doc_id long, text string, pack long, keys string"


def brute(rows, symbols, length):
    """(id, symbols, removed flags) of each row."""
    seqs = [symbols(t or "") for _, t, *_ in rows]
    seen = Counter(tuple(s[i : i + length]) for s in seqs for i in range(len(s) - length + 1))
    for (doc, *_), s in zip(rows, seqs, strict=True):
        gone = [False] * len(s)
        for i in range(len(s) - length + 1):
            if seen[tuple(s[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        yield doc, s, gone


def brute_bytes(rows, length):
    for doc, s, gone in brute(rows, lambda t: t.encode(), length):
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(s, gone, strict=True) if not g)
        yield doc, len(s), sum(gone), spans, hashlib.sha256(kept).hexdigest()


def brute_words(rows, length):
    for doc, s, gone in brute(rows, lambda t: re.findall(r"[^\x20\x09-\x0D]+", t), length):
        yield doc, len(s), sum(gone), hashlib.sha256(" ".join(w for w, g in zip(s, gone, strict=True) if not g).encode()).hexdigest()


def corpus(seed, unit):
    r = random.Random(seed)
    fresh = lambda n: [f"{unit}{r.randrange(10**5)}" for _ in range(n)]
    shared = [fresh(r.choice([3, 5, 7, 12, 40])) for _ in range(12)]
    texts = []
    for _ in range(60):
        parts = [x for _ in range(r.randrange(5)) for x in (fresh(r.randrange(12)), r.choice(shared)[r.randrange(3) :])]
        texts.append(r.choice([" ", "\n", "  "]).join(w for p in parts for w in p))
    texts += [texts[5], texts[5] + " x", None, "", "a " * 300, "ä" * 200, "z" * 90, "y", " \t\n"]
    rows = [(i * 7 % 101, t, 1, "clash") for i, t in enumerate(texts)]
    return [*rows, rows[4], (rows[4][0], "same id, other text", 1, ""), (None, texts[6], 1, "")]


@pytest.mark.parametrize(("length", "k"), [(30, 12), (21, 20), (40, 5), (9, 4), (64, 64)])
def test_suffix_dedup(spark, length, k):
    rows = corpus(length, "é")
    got = suffix_dedup(spark.createDataFrame(rows, SCHEMA).repartition(4), length, k).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_bytes(rows, length), key=str)


def test_radix_groups():
    r = random.Random(8)
    for depth in (3, 8, 11, 24):
        data = np.array([r.choice([0, 255, 7]) for _ in range(4000)], np.uint8)
        data[2000:2500] = data[100:600]
        at = np.arange(4000 - depth)
        r.shuffle(at)
        weight = np.array([r.choice([1, 1, 1, 2]) for _ in at])
        strings = [data[a : a + depth].tobytes() for a in at]
        total = Counter()
        for s, w in zip(strings, weight.tolist(), strict=True):
            total[s] += w
        alive, group = radix_groups(data, at, depth, weight)
        assert sorted(alive.tolist()) == [i for i, s in enumerate(strings) if total[s] > 1]
        seen = {}
        assert all(seen.setdefault(g, strings[i]) == strings[i] for i, g in zip(alive.tolist(), group.tolist(), strict=True)) and len(seen) == len({strings[i] for i in alive.tolist()})
        assert [seen[g] for g in sorted(seen)] == sorted(seen.values())


@pytest.mark.parametrize("length", [2, 6, 9, 12])
def test_substring_dedup(spark, length):
    rows = corpus(length, "é")
    got = substring_dedup(spark.createDataFrame(rows, SCHEMA).repartition(4), length).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_words(rows, length), key=str)


def branching_corpus():
    """Passages that share parts in all ways: before and behind different ones, inside each other, over themselves."""
    r = random.Random(21)
    word = lambda: f"w{r.randrange(10**6)}"
    a, b, c, d = ([word() for _ in range(n)] for n in (30, 14, 20, 8))
    texts = [a + b, a + c, b + a, c + d + b, a[5:25] + d, [word()] + a[:12] + [word()] + b, d * 6, d * 4 + [word()], a + [word()] + a[3:], b[:9] + a[20:] + c, a + b, a + b, [word() for _ in range(40)]]
    texts += [[word() for _ in range(r.randrange(6))] + r.choice([a, b, c, d])[r.randrange(5) :] + r.choice([a, b, c, d])[: r.randrange(3, 30)] for _ in range(40)]
    return [(i, " ".join(t), 1, "") for i, t in enumerate(texts)]


@pytest.mark.parametrize("length", [3, 7, 10])
def test_branching_paths(spark, length):
    rows = branching_corpus()
    got = substring_dedup(spark.createDataFrame(rows, SCHEMA).repartition(6), length).collect()
    assert sorted(map(tuple, got)) == sorted(brute_words(rows, length))


def test_words_that_polynomials_confuse(spark):
    """A Thue-Morse word and its complement have one polynomial modulo 2^64, whatever the base."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    one, other = ("".join(x[b] for b in bits) for x in ("ab", "ba"))
    same = " ".join(f"w{i}" for i in range(34))
    rows = [(1, f"{same} {one}", 1, ""), (2, f"{same} {other}", 1, ""), (3, " ".join(one), 1, ""), (4, "x " + " ".join(other), 1, "")]
    got = substring_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == sorted(brute_words(rows, 35)) and {r.n_removed for r in got if r.doc_id < 3} == {0}


@pytest.mark.parametrize("bits", [4, 9])
def test_candidates_that_only_hashes_repeat(spark, monkeypatch, bits):
    """With few bits counted almost every edge is a candidate; digests still tell them apart."""
    rows = corpus(5, "é")
    seen = list(run_locally(rows, 6, np.uint64((1 << bits + 1) - 2)))
    assert sorted(seen, key=str) == sorted(brute_words(rows, 6), key=str)


def run_locally(rows, length, mask):
    """The operator with another number of counted bits: patched where its functions run, in the workers."""
    import basalt.llm.substring_dedup as m
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    ask, answer = m._ask, m._answer

    def few(length, parts):
        inner = ask(length, parts)

        def run(batches):
            import basalt.llm.substring_dedup as inside

            inside._BITS = mask
            yield from inner(batches)
            inside._BITS = np.uint64((1 << 40) - 2)

        return run

    m._ask = few
    try:
        return [tuple(r) for r in m.substring_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3), length).collect()]
    finally:
        m._ask, m._answer = ask, answer


def test_long_texts_in_steps(spark, monkeypatch):
    import basalt.llm.repeats as repeats

    r = random.Random(9)
    base = "".join(chr(97 + r.randrange(26)) for _ in range(3000))
    rows = [(1, base + "q" + base[100:1500], 1, ""), (2, base[2000:] + "w" + base[:700], 1, "")]
    monkeypatch.setattr(repeats, "STEP", 257)
    found = repeats.contexts([byte_symbols(t.encode()) for _, t, *_ in rows], 50, 20)
    assert (found.last - found.first + 1).sum() == sum(len(t) - 49 for _, t, *_ in rows)
    got = suffix_dedup(spark.createDataFrame(rows, SCHEMA), 50, 20).collect()
    assert sorted(map(tuple, got)) == sorted(brute_bytes(rows, 50))


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup(empty).collect() == [] and substring_dedup(empty).collect() == []
    assert split_words(b" a\tb\x0b\xc2\xa0c ") == [b"a", b"b", b"\xc2\xa0c"]
