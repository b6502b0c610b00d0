"""Operator 5, secret scans: patterns of known kinds, and zstandard novelty in sensitive places.

Base kinds are found by pattern. The fourth kind, ``novel``, are strings on both
sides of a sensitive word, over lines, that a compressor cannot explain: primed with dictionaries
of identifiers and of the text around (without the string and other copies of it),
zstandard needs about one byte for each of its characters. Identifiers, paths and
dates cost a fraction of that. Candidates are quoted strings and runs of ASCII
without white space, whole or in parts, from 8 characters if they hold symbols or
are given as the word's value, else from 16. Quoted strings with white space are
read as their words.

Defined results: null and empty texts have no spans; every row is scanned by
itself, so repeated rows agree; positions are code points, ends exclusive; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import backquoted, ship, tidied

KINDS = ("assign", "access", "hex", "novel")
BASE = KINDS[:3]

# The patterns and least lengths of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# Maximal runs: a run that is too short can't match, so those of the least length and more are all.
HEX = re.compile(rf"[0-9a-f]{{{HEX_LEAST},}}")
#: What a lower-cased text must hold for ASSIGN to match.
ASSIGN_HINTS = ("passw", "secret", "token", "api_key", "apikey")

_WORD = r"(?:passw|passphrase|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|credential|authorization|bearer)"
SENSITIVE = re.compile(_WORD, re.IGNORECASE | re.ASCII)
SENSITIVE_HINTS = (*ASSIGN_HINTS, "passphrase", "key", "credential", "authorization", "bearer")
LEAST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
#: Least length of fields with symbols.
SHORT = 8
#: Quoted strings without white space, or runs of ASCII without white space and quotes.
FIELD = re.compile(rf""" "([!#-~]{{{SHORT},}}+)" | '([!-&(-~]{{{SHORT},}}+)' | `([!-_a-~]{{{SHORT},}}+)` | [!#-&(-_a-~]{{{SHORT},}}+ """, re.VERBOSE)
#: What parts of a field are made of; punctuation of configuration, code and URLs divides them.
PART = re.compile(rf"""[^\s=:&?,;|/@(){{}}<>\[\]"'`\\]{{{SHORT},}}+""")
#: Punctuation that names, paths, numbers and dates have isn't counted as a symbol.
SYMBOL = re.compile(r"[!#$%&*+?@^~|\\]")
OPENING, CLOSING = "([{<,;:=-", ")]}>,;:."
#: The name before a value in the same field; a sensitive word and what may stand between it and its value.
NAME = re.compile(r"[-A-Za-z_.]++(?::=|=>|[=:])")
VALUED = re.compile(_WORD + r"[\w.-]*[\"'`\]]*\s*(?::=|=>|[:=])\s*[>|]?[-+]?\s*[\"'`]?$", re.IGNORECASE | re.ASCII)
VALUE_REACH = 96
PEM = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY[A-Z ]*-----((?:(?!-----).)*+)-----END", re.DOTALL)
#: Characters on both sides of a sensitive word, or behind a secret, in which fields are read; characters around a candidate that prime the compressor.
REACH, AROUND = 256, 256
#: Longer candidates are measured by the mean of pieces of this length: long texts of few different characters gain from entropy coding alone.
PIECE = 48
#: Signs at the ends of a candidate that another copy of the same secret may lack.
EDGES = "+/_=-"
#: Marginal compressed bytes in percent of a candidate's length.
NOVELTY = 75

# Words that code and configuration are made of; the identifier dictionary.
IDENTIFIERS = (
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 9876543210 xxxxxxxxxxxxxxxx XXXXXXXXXXXXXXXX 0000000000000000 ---------------- ================ ________________ "
    "access account address admin allow application argument array async attribute authorization await base64 batch bearer begin boolean bucket buffer builder bytes cache callback "
    "certificate change_me channel class client cluster code collection column command common component condition config configuration connect connection constant container content "
    "context control controller convert count create credential current database datetime debug default define delete description development directory document domain double "
    "download element email encoding encrypt endpoint engine environment error event example exception execute export expression external factory failure false feature field file "
    "filter float folder format function generate global group handler hash header hidden hostname identifier image implementation import include index information initialize input "
    "insert instance integer interface internal invalid iterator json_path kernel keyword language length level library listener localhost location logger login manager mapping "
    "master message metadata method migration model module monitor namespace network notification null number object operation option output package page parameter parent parser "
    "passphrase password path pattern payload permission platform placeholder pointer policy position prefix private_key process production profile project property protocol "
    "provider proxy public_key query queue random range reader record redirect reference refresh_token region register registry release remote render replace replica repository request "
    "require reset resolve resource response result return role root route runtime sample schedule schema scope script search secret section security select sequence serialize server "
    "service session setting settings signature size snapshot socket source stage standard start state static status storage stream string struct subject submit subscription success "
    "summary support system table target task template tenant test text thread timeout timestamp token topic trace traffic transaction transform trigger true type undefined unique "
    "update upload username utility valid value variable vector vendor verify version view virtual volume warning webhook window worker workflow wrapper writer your_api_key_here "
    "http://www.example.com/ https://api.example.org/v1/ /usr/local/lib/ /var/log/ .config .json .yaml"
)

#: Words of the dictionary, before a candidate, so that the compressor's headers aren't counted as the candidate's.
LEAD = b"certificate refresh_token environment "


def _added(before: str, own: str, behind: str) -> int:
    """Bytes of own in percent; what is around is a dictionary and not part of the input, so that its letters' frequencies explain nothing."""
    import zstandard

    known = (IDENTIFIERS + "\n" + behind + "\n" + before).encode("utf-8", "replace")
    primer = zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    compress = zstandard.ZstdCompressor(level=9, dict_data=primer, write_content_size=False, write_checksum=False, write_dict_id=False).compress
    data = own.encode("utf-8", "replace")
    step = -(-len(data) // -(-len(data) // PIECE))
    pieces = [data[i : i + step] for i in range(0, len(data), step)]
    return 100 * (sum(len(compress(LEAD + x)) for x in pieces) - len(pieces) * len(compress(LEAD))) // len(data)


def novelty(text: str, start: int, end: int) -> int:
    """Bytes that the string adds to its compressed surroundings, in percent of its length."""
    return _added(text[max(0, start - AROUND) : start], text[start:end], text[end : end + AROUND])


def novelty_alone(text: str, start: int, end: int) -> int:
    """Novelty where other copies of the string are blanked, so that none explains another.

    Copies count without the signs at their ends, and those cut by the edge of the surroundings too.
    """
    own = text[start:end]
    core = own.strip(EDGES) or own
    blank, more = " " * len(core), len(core) - 1
    before = text[max(0, start - AROUND - more) : start].replace(core, blank)[-AROUND:]
    behind = text[end : end + AROUND + more].replace(core, blank)[:AROUND]
    return _added(before, own, behind)


def _kinds(own: str) -> int:
    """Of digits, small letters, capitals behind the first character and symbols, how many the string has."""
    return bool(re.search("[0-9]", own)) + bool(re.search("[a-z]", own)) + bool(re.search("[A-Z]", own[1:])) + bool(SYMBOL.search(own))


def _is_candidate(own: str, valued: bool) -> bool:
    if CANDIDATE.fullmatch(own):
        return sum(bool(re.search(p, own)) for p in ("[0-9]", "[a-z]", "[A-Z]")) >= 2
    if len(own) < SHORT:
        return False
    if valued:
        return _kinds(own) >= 2
    # A bare short string near a word, but not given as its value, may be any name in code.
    return _kinds(own) >= 3 and (len(own) >= LEAST or bool(SYMBOL.search(own) and re.search("[0-9]", own)))


def _overlaps(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether one of the spans, sorted and apart from each other, has a character in this range."""
    i = bisect_left(spans, (end,))
    return i > 0 and spans[i - 1][1] > start


def _in_field(text: str, start: int, end: int, quoted: bool) -> Iterator[tuple[int, int]]:
    """The secrets of a field: the field, or its value behind a name, whole if that is novel, else runs and parts of it."""
    name = NAME.match(text, start, end)
    begin = name.end() if name else start
    valued = quoted or bool(VALUED.search(text[max(0, begin - VALUE_REACH) : begin]))
    left, right = begin, end
    if not quoted:
        left += len(text[left:right]) - len(text[left:right].lstrip(OPENING))
        right -= len(text[left:right]) - len(text[left:right].rstrip(CLOSING))
    whole = [] if "://" in text[start:end] else [(left, right, valued)]
    runs = [(*m.span(), False) for m in CANDIDATE.finditer(text, start, end)]
    parts = [(*m.span(), valued and m.start() == left) for m in PART.finditer(text, start, end)]
    found: list[tuple[int, int]] = []
    for a, b, given in (*whole, *runs, *parts):
        if not _overlaps(found, a, b) and _is_candidate(text[a:b], given) and novelty_alone(text, a, b) >= NOVELTY:
            insort(found, (a, b))
    yield from found


def _novel(text: str) -> list[tuple[int, int]]:
    found: list[tuple[int, int]] = []
    field, ahead, at, stop = None, -1, 0, 0
    for word in (*SENSITIVE.finditer(text), None):
        # A secret carries the reach on, so that blocks of many lines are seen to their end.
        while at < stop:
            # The next field may lie far ahead: it is looked for once.
            if ahead < at:
                field = FIELD.search(text, at)
                ahead = field.start() if field else len(text)
            if not field or ahead >= stop:
                break
            at = field.end()
            which = field.lastindex or 0
            for start, end in _in_field(text, *field.span(which), which > 0):
                found.append((start, end))
                stop = max(stop, end + REACH)
        if word:
            # No field that ends in reach is cut in two: back to its begin, but not behind what was read.
            reach = max(at, word.start() - REACH)
            at = max(at, *[text.rfind(c, at, reach) + 1 for c in " \n\t"]) if reach > at else at
            stop = max(stop, word.end() + REACH)
    return _bodies(text, found)


def _bodies(text: str, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Key bodies with a novel string in them as one span each, short last lines included; the other spans as they are."""
    if "-----BEGIN" not in text:
        return found
    bodies = [(m.start(1) + len(m[1]) - len(m[1].lstrip()), m.start(1) + len(m[1].rstrip())) for m in PEM.finditer(text)]
    bodies = [(a, b) for a, b in bodies if _overlaps(found, a, b)]
    return sorted([*bodies, *[(a, b) for a, b in found if not _overlaps(bodies, a, b)]])


def spans_of(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every secret, by start, then kind as listed."""
    found = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    if any(h in low for h in SENSITIVE_HINTS):
        found += [(a, b, "novel") for a, b in _novel(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def written_spans(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redacted(text: str, spans: list[tuple[int, int, str]], by: str = "[SECRET]") -> str:
    """The text with every span, or union of overlapping spans, replaced."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], by]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list] = [[], [], [], [], [], []]
        for value in batch.column("text"):
            spans = spans_of(value.as_py() or "")
            kinds = [k for *_, k in spans]
            row = [*[kinds.count(k) for k in KINDS], hashlib.sha256(written_spans([s for s in spans if s[2] in BASE]).encode()).hexdigest(), written_spans(spans)]
            for column, x in zip(columns, row, strict=True):
                column.append(x)
        types = [pa.int64()] * 4 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]],
            names=["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"],
        )


def secret_scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_novel, base_sha256 and spans of each row of docs."""
    ship(docs.sparkSession)
    source = docs.select(F.col(backquoted(key)).alias("doc_id"), F.col(backquoted(text)).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(tidied(_scan), f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the secrets of its text column replaced; all else, nulls included, as it was."""
    ship(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if (t := v.as_py()) is None else redacted(t, s) if (s := spans_of(t)) else t for v in batch.column(at)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(tidied(run), docs.schema)
