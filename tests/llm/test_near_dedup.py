"""Near-duplicates and components against brute force over all pairs."""

import random
import re

import pytest

from basalt.llm.components import components
from basalt.llm.near_dedup import near_dedup, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def word_set(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def roots(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def brute(rows):
    sets = [(i, word_set(t)) for i, t, *_ in rows]
    links = [
        (a, b) for x, (a, s) in enumerate(sets) for b, t in sets[:x] if a is not None and b is not None and s and t and 100 * len(s & t) >= 75 * len(s | t)
    ]
    top = roots({i for i, _ in sets if i is not None}, links)
    return sorted([(i, len(s), top.get(i), i is None or top[i] == i) for i, s in sets], key=str)


def corpus(seed, families=12, size=12):
    r = random.Random(seed)
    rows = []
    for _ in range(families):
        base = [f"w{r.randrange(10**6)}" for _ in range(r.choice([6, 40, 120, 400]))]
        for _ in range(r.randrange(1, size)):
            copy = list(base)
            for _ in range(r.randrange(0, max(2, len(base) // 18))):
                copy[r.randrange(len(copy))] = f"x{r.randrange(10**6)}"
            rows.append(r.choice([" ", "\n", " \t"]).join(copy) if r.random() < 0.8 else " ".join(copy).upper())
    r.shuffle(rows)
    return [(i * 3 % 1009, t, 1, "clash") for i, t in enumerate(rows)]


SCHEMA = "doc_id long, text string, family long, component string"
ODD = [(5000, None, 1, ""), (5001, "", 1, ""), (5002, " \n ", 1, ""), (5003, "one two", 1, ""), (5004, "One\ttwo", 1, ""), (5005, "one two three", 1, ""), (None, "one two", 1, ""), (5003, "one two", 1, ""), (5003, "a different text of words here", 1, ""), (5006, "A different text of words here", 1, "")]


def test_shingles_are_sets():
    assert len(shingles("a b c d e a b c d e")) == len(word_set("a b c d e a b c d e")) == 5
    assert shingles("A b C").tolist() == shingles("a\nB  c").tolist() != shingles("a b").tolist()


@pytest.mark.parametrize("chunk_bytes", [500_000, 3000])
def test_near_dedup(spark, chunk_bytes):
    rows = corpus(1) + ODD
    base = [f"v{i}" for i in range(150)]
    r = random.Random(5)
    for i in range(60):
        copy = list(base)
        for _ in range(r.randrange(0, 9)):
            copy[r.randrange(150)] = f"y{r.randrange(10**6)}"
        rows.append((2000 + i, " ".join(copy), 1, ""))
    got = sorted(map(tuple, near_dedup(spark.createDataFrame(rows, SCHEMA).repartition(5), chunk_bytes=chunk_bytes).collect()), key=str)
    assert got == brute(rows)


def test_later_meetings(spark):
    """Chains whose neighbours alone are similar, tied into one family: most links are far from the family's first chunk."""
    r = random.Random(9)
    rows = []
    for chain in range(4):
        words = [f"c{chain}x{i}" for i in range(80)]
        for step in range(30):
            words[step * 2 % 80] = f"n{r.randrange(10**9)}"
            rows.append((r.randrange(10**6), " ".join(words)))
    rows = [(i * 1000 + at, text) for at, (i, text) in enumerate(rows)]
    # The same numbers again, so that an id has several texts.
    rows += [(rows[0][0], "another text under the id of the first one"), (rows[1][0], rows[50][1])]
    got = sorted(map(tuple, near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), chunk_bytes=2000).collect()), key=str)
    assert got == brute(rows)


def test_words_that_polynomials_confuse(spark):
    """A Thue-Morse word and its complement have one polynomial modulo 2^64, whatever the base."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    one, other = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    rows = [(1, one), (2, other), (3, " ".join(one)), (4, " ".join(other)), (5, "x " * 4 + one), (6, "x " * 4 + other)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: (n, c) for i, n, c, _ in brute([(*r,) for r in rows])}
    assert got == want and got[2][1] == 2 and got[6][1] == 6


def test_empty(spark):
    assert near_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("small", [10**6, 0])
def test_components(spark, small):
    r = random.Random(3)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(160)] + [(1000, i) for i in range(1001, 1100)] + [(i, i + 1) for i in range(2000, 2020)] + [(7, 7)]
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long"), small).collect()}
    nodes = {x for link in links for x in link if link[0] != link[1]}
    assert got == {n: c for n, c in roots(nodes, [x for x in links if x[0] != x[1]]).items()}
    assert components(spark.createDataFrame([], "a long, b long"), small).collect() == []
