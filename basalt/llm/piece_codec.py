"""Operator 2, SentencePiece encoding and decoding by a weighted transducer.

The model's file is compiled once a process into transducers that are composed with
each input:

* the *normaliser*: states are the prefixes of the keys of the model's character map,
  a final state writes what its key becomes, and the longest key is taken; characters
  outside all keys are copied. Then spaces become marks, after the model's rules (a
  mark before the text; runs of spaces as one, none at the ends);
* the *lexicon*: states are the prefixes of pieces. An arc path that reads a piece
  writes its id and ends in the state of that piece, at the weight of the piece;
* the *byte fallback*: an arc that reads a character which is no piece, writes the ids
  of its UTF-8 bytes and ends in the state of that character.

The composition with an input has a state for each position and each state of the
lexicon that ends there; it is made as far as it can be reached, its arcs found by the
lexicon's failure links. Weights are of the
tropical semiring: along a path they are added, and of the paths into a state the
least remains, the first found of equals.

Weights follow the kind of the model. In a unigram model a piece weighs what its
score lacks, and the state behind every piece is the same. In a model of merges (BPE)
a piece weighs its rank, and one more weight stands between two pieces: nothing if
merging the characters of both gives both back, else infinity, the semiring's zero.
Merges never look beyond the pieces that they join, so a segmentation is what the
merges give exactly if all its neighbours bind: one path of finite weight is left.

Inputs are composed unit by unit: no piece has a mark behind another character, so no
arc crosses the begin of a run of marks, and none joins two characters that are
neighbours in no piece. In models of merges the results of units are kept, in a
bounded memory.

Decoding runs the lexicon backwards: pieces to characters, runs of byte ids to UTF-8
(what is no UTF-8 becomes U+FFFD byte by byte), marks to spaces, without those that
the normaliser put in front.

Models are refused (ValueError) that have no byte pieces, pieces of the user, unused
pieces, a piece with a mark behind another character, or marks behind words.

Defined results: null encodes like the empty text, as no ids; repeated rows one by
one; columns that aren't named are never looked at; an empty table gives an empty
result; a very long text goes unit by unit, a unit without any place to cut in one go.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import inf
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import backquoted, ship, tidied
from .piece_model import PieceModel, read_model

MARK = "▁"
#: Entries of the memories of units and of neighbours, of each of two generations; the longest unit kept.
UNITS_KEPT, PAIRS_KEPT, LONGEST = 100_000, 100_000, 64
#: Weight of a byte fallback beyond the heaviest piece of a unigram model.
FALLBACK = 10.0


class Kept(dict):
    """A dict of two generations: the older goes when the younger is full."""

    def __init__(self, most: int, make):
        super().__init__()
        self.most, self.make, self.old = most, make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) > LONGEST:
            return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Trie:
    """States of prefixes: arcs by character, and what final states write."""

    def __init__(self):
        self.arcs: list[dict[str, int]] = [{}]
        self.final: list = [None]

    def add(self, key: str, output) -> None:
        state = 0
        for c in key:
            after = self.arcs[state].get(c)
            if after is None:
                after = self.arcs[state][c] = len(self.arcs)
                self.arcs.append({})
                self.final.append(None)
            state = after
        self.final[state] = output


class Normaliser:
    """The model's character map and rules of spaces."""

    def __init__(self, model: PieceModel):
        self.trie = Trie()
        for key, becomes in model.character_map.items():
            self.trie.add(key, becomes)
        self.begins = frozenset(self.trie.arcs[0])
        self.dummy, self.squeeze = model.dummy_prefix, model.remove_extra_spaces

    def rewritten(self, text: str) -> str:
        """The composition of the map with a text: longest keys from the left."""
        if self.begins.isdisjoint(text):
            return text
        arcs, final = self.trie.arcs, self.trie.final
        out, at, n = [], 0, len(text)
        while at < n:
            state, end, found, written = 0, at, at, None
            while end < n and (state := arcs[state].get(text[end], -1)) >= 0:
                end += 1
                if final[state] is not None:
                    found, written = end, final[state]
            if written is None:
                out.append(text[at])
                at += 1
            else:
                out.append(written)
                at = found
        return "".join(out)

    def units(self, text: str) -> list[str]:
        """The normalised text with its marks, cut before each run of marks."""
        if self.begins:
            text = self.rewritten(text)
        if not text:
            return []
        if self.squeeze:
            # A mark that the text itself holds is no space to be removed, but at the end.
            text = " ".join([w for w in text.split(" ") if w]).replace(MARK, " ").rstrip(" ")
            if not text:
                return []
        parts = text.replace(MARK, " ").split(" ")
        if "" not in parts and self.dummy:
            return [MARK + p for p in parts]
        units, marks = [], int(self.dummy)
        for i, part in enumerate(parts):
            marks += i > 0
            if part:
                units.append(MARK * marks + part)
                marks = 0
        return [*units, MARK * marks] if marks else units


class PieceTransducer:
    """The compiled model."""

    def __init__(self, model_file: str):
        import ahocorasick

        model = read_model(model_file)
        normal = model.normal
        self.normaliser = Normaliser(model)
        self.squeeze, self.strips = model.remove_extra_spaces, model.dummy_prefix or model.remove_extra_spaces
        self.ids = {p: i for i, p in enumerate(model.pieces) if i in normal}
        if len(model.byte_ids) < 256:
            raise ValueError("the model has no byte pieces")
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has a mark behind another character")
        self.fallback = [(model.byte_ids[b],) for b in range(256)]
        self.merging = model.merging
        self.split: dict[str, tuple[str, str]] = {}
        if self.merging:
            # Ranks: the order of merges; equal scores share one.
            order = {s: r for r, s in enumerate(sorted({model.scores[i] for i in self.ids.values()}, reverse=True))}
            self.rank = {p: order[model.scores[i]] for p, i in self.ids.items()}
            weights = {p: float(r) for p, r in self.rank.items()}
            for p in self.ids:
                if len(p) > 1:
                    self._learn_split(p)
        else:
            weights = {p: -model.scores[i] for p, i in self.ids.items()}
            self.fallback_weight = _single(max(weights.values()) + FALLBACK)
        self.lexicon = ahocorasick.Automaton()
        for p, i in self.ids.items():
            # A piece that its own merges don't give is on no path of finite weight.
            if not self.merging or len(p) == 1 or p in self.split:
                self.lexicon.add_word(p, (len(p), p if self.merging else "", (i,), weights[p]))
        self.lexicon.make_automaton()
        self.pieces_of_one = frozenset(p for p in self.ids if len(p) == 1)
        #: Neighbours in some piece; between any others every segmentation has a cut.
        self.joined = {pair for p in self.ids for pair in zip(p, p[1:], strict=False)}
        self.between = Kept(PAIRS_KEPT, self._between)
        self.units = Kept(UNITS_KEPT, self._unit)
        texts = model.texts(MARK)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.sizes, self.begins = sizes, np.cumsum(sizes) - sizes
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.is_byte = np.zeros(len(texts), bool)
        self.is_byte[list(model.byte_ids.values())] = True
        self.lone_marks = np.array([p[:1] == MARK for p in model.pieces])

    def _learn_split(self, piece: str) -> None:
        """The two pieces that the last merge inside a piece joins, if its merges give the piece."""
        parts, rank = list(piece), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                return
            if len(parts) == 2:
                self.split[piece] = (parts[0], parts[1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _between(self, pair: tuple[str, str]) -> float:
        """The weight between two pieces: 0 if no merge crosses from one to the other, else infinity.

        Merges are taken back, the latest first, and the pair that then meets at the
        border would have merged if its rank is before that of the merge taken back
        (or equal to it, to the right of the border).
        """
        a, b = pair
        rank, split = self.rank, self.split
        before = inf
        while True:
            r = rank.get(a + b)
            if r is not None and r < before:
                return inf
            of_a, of_b = (rank[a] if a in split else -1), (rank[b] if b in split else -1)
            if of_a > of_b:
                before, a = of_a, split[a][1]
            elif of_b >= 0:
                before, b = of_b + 1, split[b][0]
            else:
                return 0.0

    def shortest_path(self, unit: str, so_far: float = 0.0) -> tuple[list[int], float]:
        """The ids along the least path of the composition of fallback and lexicon with a unit, and the path's weight on top of what lies before.

        One state a position is enough: unigram models have but one, and of the states
        of a position one at most is reached at a finite weight in models of merges.
        """
        n, merging, between = len(unit), self.merging, self.between
        weight, state, begin, out = [inf] * (n + 1), [""] * (n + 1), [0] * (n + 1), [()] * (n + 1)
        weight[0] = so_far
        known = self.pieces_of_one.issuperset(unit)
        settled = n if known else 0
        # Arcs by their ends, of one end the longest first; each begins where all arcs are behind it.
        for last, (size, to, ids, cost) in self.lexicon.iter(unit):
            if settled < last:
                self._relax_fallback(unit, settled, last, weight, state, begin, out)
                settled = last
            end = last + 1
            at = end - size
            if merging:
                # There is but one finite path: what is found isn't bettered.
                if weight[end] < inf or weight[at] == inf or ((before := state[at]) and between[before, to]):
                    continue
                weight[end], state[end], begin[end], out[end] = weight[at] + cost, to, at, ids
                continue
            # Unigram sums are rounded to single precision, as the library's: that decides between paths of equal pieces.
            total = _single(weight[at] + cost)
            if total < weight[end]:
                weight[end], state[end], begin[end], out[end] = total, to, at, ids
        if settled < n:
            self._relax_fallback(unit, settled, n, weight, state, begin, out)
        path, end = [], n
        while end:
            path.append(out[end])
            end = begin[end]
        return [i for ids in reversed(path) for i in ids], weight[n]

    def _relax_fallback(self, unit: str, low: int, high: int, weight: list, state: list, begin: list, out: list) -> None:
        """The arcs of the byte fallback that begin in a range."""
        for at in range(low, high):
            c = unit[at]
            if c in self.ids or weight[at] == inf:
                continue
            to, total = (c, weight[at]) if self.merging else ("", _single(weight[at] + self.fallback_weight))
            if total < weight[at + 1] and not (self.merging and state[at] and self.between[state[at], to]):
                weight[at + 1], state[at + 1], begin[at + 1], out[at + 1] = total, to, at, self._fallback_ids(c)

    def _fallback_ids(self, c: str) -> tuple[int, ...]:
        return tuple(i for b in c.encode("utf-8", "replace") for i in self.fallback[b])

    def _unit(self, unit: str) -> bytes:
        joined = self.joined
        # Words of letters are rarely cut, and need not be.
        cuts = [] if unit.lstrip(MARK).isalpha() else [i for i, pair in enumerate(zip(unit, unit[1:], strict=False), 1) if pair not in joined]
        if cuts:
            return b"".join([self.units[unit[a:b]] for a, b in zip([0, *cuts], [*cuts, len(unit)], strict=True)])
        ids, _ = self.shortest_path(unit)
        return pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text."""
        if not self.merging:
            # Weights run on through the text, since rounding depends on them; so nothing is kept.
            found, weight = [], 0.0
            for unit in self.normaliser.units(text):
                ids, weight = self.shortest_path(unit, weight)
                found += ids
            return np.array(found, "<u4")
        return np.frombuffer(b"".join(map(self.units.__getitem__, self.normaliser.units(text))), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids."""
        if not len(ids):
            return ""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        places = np.repeat(self.begins[ids] - (ends - sizes), sizes) + np.arange(ends[-1])
        data = self.bytes[places].tobytes()
        if self.strips:
            data = data[self._marks_before(ids, sizes) :]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return _lossy(data)

    def _marks_before(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """Marks in front that the normaliser may have put there: one, or that of each piece before any other character."""
        gone = 0
        for i, size in zip(ids.tolist(), sizes.tolist(), strict=True):
            if self.is_byte[i] or not self.lone_marks[i]:
                if size:
                    break
                continue
            gone += 1
            if size > 1 or not self.squeeze:
                break
        return gone


def _single(x: float) -> float:
    return float(np.float32(x))


def _lossy(data: bytes) -> str:
    out, at = [], 0
    while at < len(data):
        try:
            out.append(data[at:].decode())
            break
        except UnicodeDecodeError as e:
            out += [data[at : at + e.start].decode(), "\ufffd"]
            at += e.start + 1
    return "".join(out)


_compiled: dict[str, PieceTransducer] = {}


def transducer(model_file: str) -> PieceTransducer:
    """The transducer of a model file, compiled once a process."""
    if model_file not in _compiled:
        _compiled[model_file] = PieceTransducer(model_file)
    return _compiled[model_file]


def encode_pieces(docs: DataFrame, model_file: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), into: str = "ids") -> DataFrame:
    """The columns of ``keep``, and the ids of the text (array<int>, named ``into``)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model_file)
        for batch in batches:
            found = [machine.encode(t.as_py() or "") for t in batch.column(batch.num_columns - 1)]
            ends = np.cumsum([0, *map(len, found)])
            flat = np.concatenate(found) if found else np.zeros(0, "<u4")
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], names=[*keep, into])

    source = docs.select(*[F.col(backquoted(c)).alias(c) for c in keep], F.col(backquoted(text)).alias("__text"))
    fields = [f"{backquoted(c)} {source.schema[c].dataType.simpleString()}" for c in keep]
    return source.mapInArrow(tidied(run), ", ".join([*fields, f"{backquoted(into)} array<int>"]))


def decode_pieces(encoded: DataFrame, model_file: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), into: str = "text") -> DataFrame:
    """The columns of ``keep``, and the text of the ids; null ids decode as no ids."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model_file)
        for batch in batches:
            found = [machine.decode(np.array(x.as_py() or [], np.int64)) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string())], names=[*keep, into])

    source = encoded.select(*[F.col(backquoted(c)).alias(c) for c in keep], F.col(backquoted(ids)).alias("__ids"))
    fields = [f"{backquoted(c)} {source.schema[c].dataType.simpleString()}" for c in keep]
    return source.mapInArrow(tidied(run), ", ".join([*fields, f"{backquoted(into)} string"]))


def piece_codec(docs: DataFrame, model_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_pieces, ids_crc32 and round_trip (decoding gives the text back) of each row of docs."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model_file)
        for batch in batches:
            sizes, sums, same = [], [], []
            for value in batch.column("text"):
                t = value.as_py() or ""
                ids = machine.encode(t)
                sizes.append(len(ids))
                sums.append(zlib.crc32(ids.tobytes()))
                same.append(machine.decode(ids) == t)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_pieces", "ids_crc32", "round_trip"])

    source = docs.select(F.col(backquoted(key)).alias("doc_id"), F.col(backquoted(text)).alias("text"))
    return source.mapInArrow(tidied(run), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_pieces long, ids_crc32 long, round_trip boolean")
