"""A minimal perfect hash over 64-bit keys, level by level.

At each level the remaining keys fall into a bit field of twice their number; those alone on their bit keep it,
the others go on to the next level. A key's slot is the number of set bits before its own, over all levels.
Keys that never part (equal 64-bit hashes) are listed with their slots.
"""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass

import numpy as np

LEVELS = 40
_MAGIC = b"RPRSMPH1"


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """An invertible 64-bit mixer (multiply and fold)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x1234567) % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys, level + 1) % np.uint64(size)).astype(np.int64)


@dataclass
class PerfectHash:
    sizes: np.ndarray  # bits of each level
    bits: np.ndarray  # all levels' bits, one bool a bit in memory, packed in the file
    rest: np.ndarray  # keys that no level parted, sorted

    def __post_init__(self):
        self.ranks = np.r_[0, np.cumsum(self.bits)]
        self.starts = np.r_[0, np.cumsum(self.sizes)].astype(np.int64)

    @staticmethod
    def build(keys: np.ndarray) -> PerfectHash:
        left, sizes, fields = keys.astype(np.uint64), [], []
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(64, 2 * len(left))
            at = _place(left, level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            fields.append(alone)
            left = left[~alone[at]]
        return PerfectHash(np.array(sizes, np.int64), np.concatenate([np.zeros(0, bool), *fields]), np.sort(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; of a key that wasn't built in, some slot or -1. Equal keys of ``rest`` have consecutive slots; the first is given."""
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            at = _place(keys[open_], level, size) + self.starts[level]
            hit = self.bits[at]
            out[open_[hit]] = self.ranks[at[hit]]
            open_ = open_[~hit]
            if not len(open_):
                break
        if len(open_) and len(self.rest):
            at = np.searchsorted(self.rest, keys[open_])
            found = self.rest[np.minimum(at, len(self.rest) - 1)] == keys[open_]
            out[open_[found]] = self.ranks[-1] + at[found]
        return out


def dump(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays behind a magic word and a JSON header of names, types and lengths."""
    head = json.dumps([[k, a.dtype.newbyteorder("<").str, len(a)] for k, a in arrays.items()]).encode()
    return b"".join([_MAGIC, struct.pack("<I", len(head)), head, *(a.astype(a.dtype.newbyteorder("<")).tobytes() for a in arrays.values())])


def load(raw: bytes) -> dict[str, np.ndarray]:
    if raw[: len(_MAGIC)] != _MAGIC:
        raise ValueError("not an index file")
    (n,) = struct.unpack_from("<I", raw, len(_MAGIC))
    at, out = len(_MAGIC) + 4 + n, {}
    for name, kind, length in json.loads(raw[len(_MAGIC) + 4 : at]):
        out[name] = np.frombuffer(raw, kind, length, at)
        at += out[name].nbytes
    return out
