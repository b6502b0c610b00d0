"""The parts of a SentencePiece model file that encoding needs, read from its wire format.

The file is a protocol buffer: pieces (field 1: text 1, score 2, kind 3), the trainer's
settings (2), the normaliser's (3). The normaliser's character map is a size, a double
array of that many bytes, and texts that end with a zero byte.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from struct import unpack, unpack_from

import numpy as np

# Kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, MERGES = 1, 2


@dataclass
class PieceModel:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    merging: bool = False
    dummy_prefix: bool = True
    remove_extra_spaces: bool = True
    character_map: dict[str, str] = field(default_factory=dict)

    @property
    def normal(self) -> set[int]:
        return {i for i, k in enumerate(self.kinds) if k == NORMAL}

    @property
    def byte_ids(self) -> dict[int, int]:
        return {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}

    def texts(self, mark: str) -> list[bytes]:
        """What each id decodes to."""
        out = []
        for piece, kind in zip(self.pieces, self.kinds, strict=True):
            if kind == BYTE:
                out.append(bytes([int(piece[3:5], 16)]))
            elif kind == CONTROL:
                out.append(b"")
            else:
                out.append(" \u2047 ".encode() if kind == UNKNOWN else piece.replace(mark, " ").encode())
        return out


def fields(data: bytes):
    """(number, value) of each field of a message: integers, 4 or 8 raw bytes, or the bytes of a part."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(wire) or varint()
            yield key >> 3, data[at : at + size]
            at += size


def character_map(blob: bytes) -> dict[str, str]:
    """The keys of the double array, and what they become."""
    if not blob:
        return {}
    (size,) = unpack_from("<I", blob)
    units, texts = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64), blob[4 + size :]
    offset = (units >> 10) << ((units & (1 << 9)) >> 6)
    label, leaf = units & 0x800000FF, (units >> 8) & 1 == 1
    out, todo, every = {}, [(0, b"")], np.arange(1, 256)
    while todo:
        node, key = todo.pop()
        base = node ^ int(offset[node])
        if leaf[node]:
            begin = int(units[base]) & 0x7FFFFFFF
            out[key.decode()] = texts[begin : texts.index(b"\0", begin)].decode()
        places = base ^ every
        inside = places < len(units)
        inside[inside] = label[places[inside]] == every[inside]
        todo += [(int(p), key + bytes([c])) for p, c in zip(places[inside].tolist(), every[inside].tolist(), strict=True)]
    return out


def read_model(path: str) -> PieceModel:
    """The model of a file. Kinds that the transducer doesn't know are refused."""
    with open(path, "rb") as source:
        data = source.read()
    model, trainer, rules = PieceModel(), {}, {}
    for number, value in fields(data):
        if number == 1:
            piece = dict(fields(value))
            model.pieces.append(piece[1].decode())
            model.scores.append(unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            model.kinds.append(piece.get(3, NORMAL))
        elif number == 2:
            trainer = dict(fields(value))
        elif number == 3:
            rules = dict(fields(value))
    kind = trainer.get(3, UNIGRAM)
    if kind not in (UNIGRAM, MERGES):
        raise ValueError(f"models of kind {kind} are not known")
    if {USER, UNUSED} & set(model.kinds):
        raise ValueError("the model has pieces of the user or unused ones")
    if trainer.get(24, 0) or not rules.get(5, 1):
        raise ValueError("the model puts marks behind words, or has none")
    model.merging = kind == MERGES
    model.dummy_prefix, model.remove_extra_spaces = bool(rules.get(3, 1)), bool(rules.get(4, 1))
    model.character_map = character_map(rules.get(2, b""))
    return model
