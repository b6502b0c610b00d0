"""Wu-Manber search against a naive search of every window in every text."""

import hashlib
import random
import re

import pytest

from basalt.llm.decontaminate import compile_items, decontaminate, hits, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=13):
    seq, hit, found = lowered(text), set(), set()
    for item, it in items:
        w = lowered(it)
        n = min(window, len(w))
        for at in range(len(w) - n + 1) if w else ():
            for i in range(len(seq) - n + 1):
                if seq[i : i + n] == w[at : at + n]:
                    hit |= set(range(i, i + n))
                    found.add("" if item is None else str(item))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return (len(seq), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(seq))


def data(seed=0):
    r = random.Random(seed)
    vocab = ["Aa", "bb", "cC", "é", "7", "x", "漢字"]
    some = lambda n: r.choice([" ", ", ", "\n", " - "]).join(r.choice(vocab) for _ in range(n))
    items = [(i, some(r.choice([1, 2, 5, 13, 14, 30]) + i % 2)) for i in range(25)]
    items = [x for x in items if len(x[1].split()) > 4] + [(90, "Only É two"), (91, ""), (None, "no id at all"), (92, None), (93, "q"), (94, items[3][1])]
    docs = [(i, some(r.choice([0, 3, 20, 60])), "c") for i in range(60)]
    docs += [(100 + i, some(8) + " " + (items[i % len(items)][1] or "") + " " + some(9), "c") for i in range(40)]
    docs += [(200, None, "c"), (201, "", "c"), (202, "only é two", "c"), (None, "q q z q", "c"), (202, "only é two", "c"), (202, "different", "c")]
    return docs, items


def test_words():
    text = "A-b_C9 Ünïcode\x00x y [k] İI"
    assert [w.decode() for w in words(text)] == lowered(text)


def test_search_overlapping_patterns():
    found, items = hits(compile_items([("1", "a a a"), ("2", "b"), ("3", "a b")], 2), [b"a", b"a", b"a", b"b", b"c"])
    assert found == [(0, 4)] and items == {"1", "2", "3"}


@pytest.mark.parametrize("block_bytes", [16_000_000, 400])
def test_decontaminate(spark, block_bytes):
    docs, items = data()
    got = decontaminate(
        spark.createDataFrame(docs, "doc_id long, text string, items string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes
    ).collect()
    want = sorted([(i, *brute(t, items)) for i, t, _ in docs], key=str)
    assert sorted(map(tuple, got), key=str) == want


def test_empty_tables(spark):
    docs, items = data()
    no_items = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontaminate(spark.createDataFrame(docs, "doc_id long, text string, items string"), no_items).collect()} == {0}
    assert decontaminate(spark.createDataFrame([], "doc_id long, text string"), no_items).collect() == []


def test_a_block_s_size_is_bounded_by_its_text():
    r = random.Random(4)
    items = [(str(i), " ".join(f"w{r.randrange(9999)}" for _ in range(r.choice([5, 60, 200])))) for i in range(3000)]
    searchers = compile_items(items)
    assert sum(s.nbytes for s in searchers) < 10 * sum(len(t) for _, t in items)
    text = words("before it " + items[7][1] + " and behind " + items[8][1])
    assert {"7", "8"} <= hits(searchers, text)[1]
