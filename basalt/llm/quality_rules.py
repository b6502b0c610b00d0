"""Operator 3, quality rules: one table of thresholds, compiled into one projection.

Every measure is a Spark expression over the whole text, and every row of
``THRESHOLDS`` becomes one comparison of two measures; nothing runs outside the
JVM and nothing is shuffled.

Defined results: a null or empty text has no words, so it fails the base rule;
a document in another language than a threshold's, or in none that is known (null),
passes that threshold; repeated rows are judged one by one and alike; an empty table
gives an empty result; other columns of the input are never looked at, whatever their
names; a very long text takes time and memory in proportion to its words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import backquoted

# The characters between words and the symbol characters.
WORD_GAPS = " \t\n\x0b\f\r"
SYMBOLS = r"#*$%&|<>"

# Frequent function words of English, German, Spanish and French.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "with", "was", "be", "on", "as", "at", "by", "it", "from",
    "der", "die", "das", "und", "zu", "den", "von", "ist", "nicht", "mit", "ein", "eine", "auf", "des", "dem",
    "el", "la", "de", "que", "y", "los", "del", "se", "las", "un", "por", "con", "no", "una", "su", "para", "en",
    "le", "les", "et", "des", "du", "une", "est", "pour", "dans", "qui", "sur", "pas", "au", "il", "ne",
)


@dataclass(frozen=True)
class Threshold:
    """A document is rejected where 1000 * part > most * whole, or < least * whole; with languages, only a document in one of them."""

    rule: str
    part: str
    whole: str
    least: int | None = None
    most: int | None = None
    languages: tuple[str, ...] | None = None


# The languages that the stop words are of, and that part words by spaces.
KNOWN = ("en", "de", "es", "fr")
# Parts of a thousand, of measures in MEASURES.
THRESHOLDS = (
    Threshold("mean word length", "word_chars", "n_words", least=2_000, most=15_000, languages=KNOWN),
    # A table has a mark for each cell, so up to one a word.
    Threshold("symbols to words", "n_symbols", "n_words", most=1_000),
    Threshold("lines that repeat", "n_dup_lines", "n_lines", most=500),
    Threshold("stop words", "n_stop_words", "n_words", least=10, languages=KNOWN),
)


def _words(text: Column) -> Column:
    spaced = F.regexp_replace(text, r"[\t-\r]", " ")
    return F.array_remove(F.split(spaced, " "), "")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(WORD_GAPS)) != "")


def _measured(df: DataFrame, text: str) -> DataFrame:
    """df with the measures; each array is a column of its own, so it is computed once."""
    before = [F.col(backquoted(c)) for c in df.columns if c != text]
    words, lines, grams, order = (f"__{x}" for x in ("words", "lines", "grams", "order"))
    t = F.coalesce(F.col(backquoted(text)), F.lit(""))
    df = df.withColumn(words, _words(t)).withColumn(lines, _lines(t))
    n = F.size(words)
    at = lambda i: F.get(F.col(words), i)
    df = df.withColumn(
        grams,
        F.when(
            n >= 3,
            F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.concat_ws(" ", at(i), at(i + 1), at(i + 2)).alias("gram"), i.alias("at"))),
        ),
    )
    df = df.withColumn(order, F.sort_array(F.col(grams)))
    gram = lambda i: F.get(F.col(order), i)["gram"]
    repeated = F.filter(F.col(order), lambda g, i: (g["gram"] == gram(i + 1)) | (g["gram"] == gram(i - 1)))
    covered = F.array_distinct(F.flatten(F.transform(repeated, lambda g: F.array(g["at"], g["at"] + 1, g["at"] + 2))))
    stops = F.array(*[F.lit(w) for w in STOP_WORDS])
    measures = F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, rf"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.size(covered), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.filter(F.col(words), lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
    )
    # Out of a one-row generator: a filter on a measure stays above it. Pushed through the
    # projections, it would repeat their arrays inside its own loops, at a quadratic cost.
    return df.select(*before, F.inline(F.array(measures)))


def _verdict(thresholds: tuple[Threshold, ...], language: Column | None) -> Column:
    """Whether no row of the table speaks against the document."""
    ok = F.lit(True)
    for t in thresholds:
        part, whole = F.col(t.part) * 1000, F.col(t.whole)
        here = F.lit(True)
        if t.most is not None:
            here = here & (part <= whole * t.most)
        if t.least is not None:
            here = here & (part >= whole * t.least)
        if t.languages is not None and language is not None:
            here = here | ~F.coalesce(language.isin(*t.languages), F.lit(False))
        ok = ok & here
    return ok


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")


def quality_rules(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), thresholds: tuple[Threshold, ...] = THRESHOLDS, language: str | None = None) -> DataFrame:
    """The columns of ``keep``, the measures, base_failed and kept of each row of docs.

    keep may hold any columns but those named like a measure; the text column
    may be among them. language: a column with the document's language; without it,
    thresholds for some languages hold for every document.
    """
    if clash := set(keep) & {*MEASURES, "base_failed", "kept"}:
        raise ValueError(f"columns of the input named like results: {sorted(clash)}")
    source = docs.select(*[F.col(backquoted(c)).alias(c) for c in keep], *([F.col(backquoted(language)).alias("__language")] if language else []), F.col(backquoted(text)).alias("__text"))
    base = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return _measured(source, "__text").select(
        *[F.col(backquoted(c)) for c in keep], *MEASURES, base.alias("base_failed"), (~base & _verdict(thresholds, F.col("__language") if language else None)).alias("kept")
    )
