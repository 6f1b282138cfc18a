"""Tables of a public SentencePiece model file, as plain arrays.

Only the driver reads the file; executors get the tables by broadcast.  Their
size is that of the vocabulary, whatever the corpus.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

SPACE = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
#: "No merge" among ranks.
NEVER = np.int32(2**31 - 1)


class HashTable:
    """uint64 keys to int32 values by open addressing, looked up in bulk."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        size = 1 << self.bits
        self.keys, self.values = np.full(size, np.uint64(2**64 - 1)), np.full(size, -1, np.int32)
        at, rest = self._slot(keys), np.arange(len(keys))
        while len(rest):
            free = self.values[at[rest]] == -1
            first = np.unique(at[rest[free]], return_index=True)[1]
            won = rest[free][first]
            self.keys[at[won]], self.values[at[won]] = keys[won], values[won]
            rest = np.setdiff1d(rest, won)
            at[rest] = (at[rest] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values; -1 where there is none."""
        at = self._slot(keys)
        found, out = self.keys[at], self.values[at]
        off = np.flatnonzero((found != keys) & (out != -1))
        while len(off):
            out[off] = -1
            at[off] = (at[off] + 1) & (len(self.keys) - 1)
            hit = self.keys[at[off]] == keys[off]
            out[off[hit]] = self.values[at[off[hit]]]
            off = off[~hit & (self.values[at[off]] != -1)]
        return out


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    bos: int
    eos: int
    unknown: int
    dummy_prefix: bool
    charmap: dict[bytes, bytes]
    chars: np.ndarray  # code point -> symbol: a piece, or len(pieces) + code point
    pairs: HashTable  # pair of symbols -> piece
    ranks: np.ndarray  # piece -> rank; lower merges first, equal ranks from the left
    byte_ids: np.ndarray
    surface: list[bytes]  # what a piece decodes to; a space for SPACE

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path, "rb") as file:
            model = pb.ModelProto.FromString(file.read())
        rules = model.normalizer_spec
        if rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("models that drop white space are not supported")
        pieces, kinds = [p.piece for p in model.pieces], np.array([p.type for p in model.pieces])
        scores, size = np.array([p.score for p in model.pieces]), len(model.pieces)
        ids = {p: i for i, p in enumerate(pieces) if kinds[i] == _NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in ids):
            raise ValueError("a piece spans two words")
        chars = np.arange(0x110000, dtype=np.int32) + size
        for p, i in ids.items():
            if len(p) == 1:
                chars[ord(p)] = i
        symbol = lambda s: ids.get(s, size + ord(s) if len(s) == 1 else -1)
        keys, values = [], []
        for p, i in ids.items():
            for cut in range(1, len(p)):
                a, b = symbol(p[:cut]), symbol(p[cut:])
                if a >= 0 and b >= 0:
                    keys.append(a << 32 | b)
                    values.append(i)
        ranks = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        byte_ids = np.full(256, model.trainer_spec.unk_id, np.int64)
        surface = []
        for i, p in enumerate(pieces):
            if kinds[i] == _BYTE:
                byte_ids[int(p[3:5], 16)] = i
                surface.append(bytes([int(p[3:5], 16)]))
            else:
                surface.append(b"" if kinds[i] == _CONTROL else model.trainer_spec.unk_surface.encode() if kinds[i] == _UNKNOWN else p.replace(SPACE, " ").encode())
        return cls(
            pieces, scores, kinds, model.trainer_spec.bos_id, model.trainer_spec.eos_id, model.trainer_spec.unk_id, rules.add_dummy_prefix, read_charmap(rules.precompiled_charsmap), chars,
            HashTable(np.array(keys, np.uint64), np.array(values, np.int32)), ranks, byte_ids, surface,
        )


def read_charmap(blob: bytes) -> dict[bytes, bytes]:
    """The prefix rules of a compiled character map.

    The file's format: a 32-bit length, a double-array trie of 32-bit units,
    then the NUL-ended replacements that the trie's values point into.
    """
    if not blob:
        return {}
    (size,) = struct.unpack_from("<I", blob)
    units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
    texts = blob[4 + size :]
    offset = lambda unit: (unit >> 10) << ((unit & (1 << 9)) >> 6)
    rules: dict[bytes, bytes] = {}
    todo = [(offset(units[0]), b"")]
    while todo:
        base, prefix = todo.pop()
        for label in range(1, 256):
            at = base ^ label
            if at < len(units) and units[at] & 0x800000FF == label:
                key, child = prefix + bytes([label]), at ^ offset(units[at])
                if units[at] >> 8 & 1:
                    value = units[child] & 0x7FFFFFFF
                    rules[key] = texts[value : texts.index(b"\0", value)]
                todo.append((child, key))
    return rules
