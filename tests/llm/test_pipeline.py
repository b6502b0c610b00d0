"""The pipeline against the brute-force versions of its stages, on small tables."""

import public_tokenizers
import sentencepiece

import corpus_pipeline as p
from tests.llm.test_decontaminate import brute as contamination
from tests.llm.test_near_dedup import brute as near
from tests.llm.test_texts import brute_base

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def prose(seed, n=70):
    return " ".join(f"the {seed}x{i} of" for i in range(n))


def test_run(spark, tmp_path):
    items = [(1, " ".join(f"item word{i}" for i in range(10)))]
    rows = [
        (1, prose("a"), "en", "s", 1), (2, prose("a") + " end", "en", "s", 2), (3, prose("b"), "de", "s", 3), (4, "too short", "en", "s", 4),
        (5, prose("c", 30) + " " + items[0][1], "en", "s", 5), (6, prose("d") + " password=hunter22 on", None, None, None), (7, None, "en", "s", 7),
        (8, "the same words of " * 40, "en", "s", 8), (9, prose("e") + "\n\n ñ 漢字", "es", "s", 9),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in p.run(spark, str(tmp_path)).collect()}
    kept = [r for r in rows if r[0] not in (4, 7, 8)]
    groups = {r[0]: r[3] for r in near(kept)}
    kept = [r for r in kept if groups[r[0]] and not contamination(r[1], items)[-1]]
    assert set(got) == {r[0] for r in kept} == {1, 3, 6, 9}
    for i, text, *_ in kept:
        clean = text
        for start, end, _kind in reversed(brute_base(text)):
            clean = clean[:start] + "[SECRET]" + clean[end:]
        assert got[i].ids == LIBRARY.encode(clean)
    assert [name for name, _ in p.STAGES] == ["quality rules", "near-duplicates", "decontamination", "secrets", "pieces"]


def test_null_and_repeated_ids(spark, tmp_path):
    items = [(1, " ".join(f"item word{i}" for i in range(10)))]
    rows = [
        (None, prose("c", 30) + " " + items[0][1], "en", "s", 1), (None, prose("a"), "en", "s", 2), (None, prose("a"), "en", "s", 3), (None, prose("b"), "en", "s", 4), (3, prose("b"), "en", "s", 5),
        (5, prose("d"), "en", "s", 6), (5, prose("d"), "en", "s", 6), (5, prose("e"), "en", "s", 7), (4, prose("d") + " end", "en", "s", 8),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(((r.doc_id, r.ids) for r in p.run(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(((i, LIBRARY.encode(t)) for i, t in [(None, prose("a")), (3, prose("b")), (5, prose("e")), (4, prose("d") + " end")]), key=str)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, row int, component_id long, n_words long, __text string"


def test_odd_tables(spark, tmp_path):
    """Extra columns with clashing names, equal rows, ties, nulls in every column, a very long text; and tables without rows."""
    item = " ".join(f"item word{i}" for i in range(10))
    more = ("x", 1, 2, 3, "y")
    long = " ".join(f"the w{i} of" for i in range(200_000))
    rows = [(1, prose("a"), None, None, None, *more), (1, prose("a"), None, None, None, *more), (2, prose("a"), "en", "s", 1, *more), (None, None, None, None, None, *[None] * 5), (4, "", "", "", 0, *more), (6, long, "en", "s", 1, *more), (7, prose("b"), "fi", "s", 1, *[None] * 5)]
    docs, items = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(1, item, "c")], "item_id long, text string, doc_id string")
    for name, some, bench in (("full", docs, items), ("empty", docs.where("false"), items), ("none", docs, items.where("false"))):
        some.write.parquet(str(tmp_path / name / "documents.parquet"))
        bench.write.parquet(str(tmp_path / name / "benchmark.parquet"))
        got = sorted(((r.doc_id, r.n_pieces) for r in p.run(spark, str(tmp_path / name)).collect()), key=str)
        texts = {} if name == "empty" else {1: prose("a"), 6: long, 7: prose("b")}
        assert got == [(i, len(LIBRARY.encode(t))) for i, t in texts.items()]
