"""Byte-level BPE by units: pieces of text that encode alike alone and in place.

The pre-tokeniser's pattern is memoryless: from a position where one of its
matches begins, it goes on as at the start of a text. A space after a character
that is no white space always begins a match, so a text may be cut before every
such space and the pieces encoded apart. The ids of a piece are kept, since most
pieces come again.
"""

from __future__ import annotations

import os
import re

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# What may count as white space before a space, beside Python's own.
_MORE_SPACE = "\u180e\u200b\ufeff"
_SPACE = re.compile(rf"[\s{_MORE_SPACE}]\Z")

#: Entries of one cache before its older half goes, and the longest unit that is kept.
CACHE_UNITS, LONGEST = 300_000, 64

_tokenizers: dict = {}


def tokenizer(path: str):
    """The tokenizer of the file, read once a process."""
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        found.no_truncation()
        found.no_padding()
        _tokenizers[path] = found
    return _tokenizers[path]


class Ambiguous(Exception):
    """A cut that is not known to begin a match."""


# Fixed value: the pattern of the byte-level pre-tokeniser.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters below this one are of the same class for every Unicode version.
SETTLED = "\u0250"


def byte_letters() -> dict[int, str]:
    """The letters that stand for the UTF-8 bytes of each settled character in a byte-level vocabulary."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    letter = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(ord(SETTLED))}


class UnitCache(dict):
    """Unit without its leading space -> made(ids), which adds up; two generations bound its size.

    A unit of settled characters is cut further, into the matches of the pattern; a
    match of letters goes straight to the tokenizer's model.
    """

    def __init__(self, path: str, made, lead: str, bare: UnitCache | None = None):
        super().__init__()
        import regex

        self.encoder, self.made, self.lead, self.old = tokenizer(path), made, lead, {}
        self.merges, self.letters, self.bare = self.encoder.model.tokenize, byte_letters(), self if bare is None else bare
        self.lead_letters = lead.translate(self.letters)
        self.matches = regex.compile(PATTERN).findall

    def _made(self, unit: str):
        if unit.isalpha() and unit.isascii():
            return self.made([t.id for t in self.merges(self.lead_letters + unit)])
        text = self.lead + unit
        if not unit or max(unit) >= SETTLED or "<|" in unit:
            return self.made(self.encoder.encode(text, add_special_tokens=False).ids)
        if unit.isalpha():
            return self.made([t.id for t in self.merges(text.translate(self.letters))])
        matches = self.matches(text)
        if len(matches) == 1:
            return self.made(self.encoder.encode(text, add_special_tokens=False).ids)
        first = matches[0]
        value = self[first[1:]] if self.lead and first[1:].isalpha() else self.bare[first]
        for match in matches[1:]:
            value = value + self.bare[match]
        return value

    def __missing__(self, unit: str):
        value = self.old.get(unit)
        if value is None:
            if self.lead and (not unit or _SPACE.search(unit)):
                raise Ambiguous
            value = self._made(unit)
        if len(unit) > LONGEST:
            return value
        if len(self) >= CACHE_UNITS:
            self.old = dict(self)
            self.clear()
        self[unit] = value
        return value


def units(text: str) -> list[str]:
    """The units of any text; all but the first have lost their leading space."""
    parts = text.split(" ")
    out, held = [], parts[0]
    for part in parts[1:]:
        if held and not _SPACE.search(held):
            out.append(held)
            held = " " + part
        else:
            held += " " + part
    out.append(held)
    return [out[0], *[u[1:] for u in out[1:]]]


class UnitEncoder:
    """values(text): made(ids) of each unit of a text, in order."""

    def __init__(self, path: str, made):
        self.head = UnitCache(path, made, "")
        self.tail = UnitCache(path, made, " ", self.head)
        self.whole = lambda text: made(tokenizer(path).encode(text, add_special_tokens=False).ids)

    def values(self, text: str) -> list:
        parts = text.split(" ")
        try:
            if _SPACE.search(parts[0]):
                raise Ambiguous
            return [self.head[parts[0]], *map(self.tail.__getitem__, parts[1:])]
        except Ambiguous:
            pass
        head, *tail = units(text)
        out = [self.head[head]]
        for unit in tail:
            out.append(self.tail[unit] if unit and not _SPACE.search(unit) else self.whole(" " + unit))
        return out
