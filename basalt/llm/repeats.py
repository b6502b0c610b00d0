"""Windows of bytes by content: where the windows of a text have their anchors.

The anchor of a window is, of the k-grams in it, the one with the least hash, the
leftmost of equals. Equal windows have equal anchors at equal places, whatever
surrounds them. Consecutive windows share an anchor, so a text falls into few
*contexts*: runs of window starts with one anchor. Hashes only pick anchors; whether
windows are equal is for others to say.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
_BASE = U(0xD1342543DE82EF95)
_INVERSE = U(pow(0xD1342543DE82EF95, -1, 1 << 64))
#: Symbols that are worked on at once, and bits for a place among them.
STEP, PLACE = 1 << 18, U(20)


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(256, dtype=U) + U(0x51))


def mixed(symbols: np.ndarray) -> np.ndarray:
    """Bytes become mixed symbols only where they are worked on; other symbols are mixed already."""
    return _BYTE[symbols] if symbols.dtype == np.uint8 else symbols


_powers: dict = {}


def _powers_of(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base^2 ..."""
    if len(_powers.get(base, ())) < n:
        steps = np.full(max(n, STEP + 4096), base, U)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


class Prefix:
    """Polynomials modulo 2^64 of the k-grams of a sequence of symbols, mixed."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(symbols * _powers_of(_BASE, n), out=self.sums[1:])
        self.shift = _powers_of(_INVERSE, n + 1)

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.shift[:n]) if n > 0 else np.zeros(0, U)


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours."""
    have = 1
    while 2 * have <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    if have < w:
        x = np.minimum(x[: len(x) - (w - have)], x[w - have :])
    return x


@dataclass
class Contexts:
    """Arrays of one entry a context: text number, first and last window start in it, the anchor's start and hash."""

    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    at: np.ndarray
    anchor: np.ndarray


def _joined(parts: list[Contexts]) -> Contexts:
    names = ("text", "first", "last", "at", "anchor")
    if not parts:
        return Contexts(*[np.zeros(0, np.int64)] * 4, np.zeros(0, U))
    return Contexts(*[np.concatenate([getattr(p, n) for p in parts]) for n in names])


def contexts(texts: list[np.ndarray], length: int, k: int) -> Contexts:
    """The contexts of texts, each an array of bytes. Long texts go in steps that overlap by a window; a context cut there is two."""
    parts, held, size = [], [], 0

    def flush():
        nonlocal held, size
        if held:
            parts.append(_of_pieces(held, length, k))
        held, size = [], 0

    for number, symbols in enumerate(texts):
        for at in range(0, max(len(symbols) - length + 1, 0), STEP):
            piece = symbols[at : at + STEP + length - 1]
            if size + len(piece) > 2 * STEP:
                flush()
            held.append((number, at, piece))
            size += len(piece)
    flush()
    return _joined(parts)


def _of_pieces(pieces: list[tuple[int, int, np.ndarray]], length: int, k: int) -> Contexts:
    symbols = np.concatenate([p for *_, p in pieces]) if len(pieces) > 1 else pieces[0][2]
    sizes = np.array([len(p) for *_, p in pieces], np.int64)
    begins = np.cumsum(sizes) - sizes
    prefix = Prefix(mixed(symbols))
    grams = prefix.grams(k)
    keyed = (grams & ~((U(1) << PLACE) - U(1))) | np.arange(len(grams), dtype=U)
    place = (_least(keyed, length - k + 1) & ((U(1) << PLACE) - U(1))).astype(np.int64)
    # A context begins where the anchor changes or a piece begins, and ends where the next would begin or its piece has no more windows.
    new = np.ones(len(place), bool)
    new[1:] = place[1:] != place[:-1]
    stops = begins + sizes - length + 1
    new[begins[begins < len(new)]] = True
    new[stops[stops < len(new)]] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1
    piece = np.searchsorted(begins, first, side="right") - 1
    inside = first < stops[piece]
    first, last, piece = first[inside], last[inside], piece[inside]
    numbers = np.array([n for n, *_ in pieces], np.int64)
    offset = np.array([at for _, at, _ in pieces], np.int64)[piece] - begins[piece]
    return Contexts(numbers[piece], first + offset, last + offset, place[first] + offset, grams[place[first]])


def covered(n: int, first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """Whether each of n symbols is in a window that starts in one of the ranges."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, first, 1)
    np.add.at(steps, last + length, -1)
    return np.cumsum(steps[:-1], dtype=np.int32) > 0
