"""A cuckoo filter over 16-byte keys, vectorised where it is read."""

from __future__ import annotations

import struct

import numpy as np

SLOTS = 4
_KICKS = 200
_HEAD = struct.Struct("<II")


def _spread(x: np.ndarray | int, mask: int):
    """Where a fingerprint sends its key's other bucket."""
    return (x * 0x5BD1E995 >> 7) & mask


class Cuckoo:
    """Segments of buckets with SLOTS 16-bit fingerprints (0: free).

    A key may be in either of two buckets of a segment.  A full segment is left as it is and a larger one
    follows it, so that nothing must be hashed anew; a lookup sees all of them.  Keys must be inserted once
    each; remove() takes one such insertion back.  There are no false negatives.
    """

    def __init__(self, expected: int = 64):
        self.segments = [self._empty(expected)]

    @staticmethod
    def _empty(expected: int) -> np.ndarray:
        buckets = 1 << max(1, int(expected / SLOTS / 0.8).bit_length())
        return np.zeros((buckets, SLOTS), np.uint16)

    @staticmethod
    def _parts(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        halves = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
        return halves[:, 0], (halves[:, 1] % np.uint64(65535) + np.uint64(1)).astype(np.int64)

    def insert(self, keys: list[bytes]) -> None:
        hashes, prints = self._parts(keys)
        for h, f in zip(hashes.tolist(), prints.tolist(), strict=True):
            while not self._put(self.segments[-1], h, f):
                self.segments.append(self._empty(2 * self.segments[-1].size))

    @staticmethod
    def _put(table: np.ndarray, h: int, f: int) -> bool:
        mask = len(table) - 1
        at = h & mask
        trail = []
        for kick in range(_KICKS):
            for i in (at, at ^ _spread(f, mask)):
                free = np.flatnonzero(table[i] == 0)
                if len(free):
                    table[i, free[0]] = f
                    return True
            at ^= _spread(f, mask) if kick % 2 else 0
            slot = (f + kick) % SLOTS
            trail.append((at, slot, f))
            f, table[at, slot] = int(table[at, slot]), f
            at ^= _spread(f, mask)
        for i, slot, mine in reversed(trail):  # a failed insertion leaves the segment as it was
            f, table[i, slot] = int(table[i, slot]), f
            assert f == mine
        return False

    def remove(self, keys: list[bytes]) -> None:
        hashes, prints = self._parts(keys)
        for h, f in zip(hashes.tolist(), prints.tolist(), strict=True):
            for table in reversed(self.segments):
                mask = len(table) - 1
                at = h & mask
                for i in (at, at ^ _spread(f, mask)):
                    held = np.flatnonzero(table[i] == f)
                    if len(held):
                        table[i, held[0]] = 0
                        break
                else:
                    continue
                break

    def contains(self, keys: list[bytes]) -> np.ndarray:
        hashes, prints = self._parts(keys)
        found = np.zeros(len(keys), bool)
        for table in self.segments:
            mask = len(table) - 1
            at = (hashes & np.uint64(mask)).astype(np.int64)
            f = prints.astype(np.uint16)[:, None]
            found |= (table[at] == f).any(axis=1) | (table[at ^ _spread(prints, mask)] == f).any(axis=1)
        return found

    def __len__(self) -> int:
        return sum(int(np.count_nonzero(t)) for t in self.segments)

    def dump(self) -> bytes:
        return b"".join(_HEAD.pack(len(t), SLOTS) + t.astype("<u2").tobytes() for t in self.segments)

    @classmethod
    def load(cls, data: bytes) -> "Cuckoo":
        out, at = cls.__new__(cls), 0
        out.segments = []
        while at < len(data):
            buckets, slots = _HEAD.unpack_from(data, at)
            at += _HEAD.size
            out.segments.append(np.frombuffer(data, "<u2", buckets * slots, at).reshape(buckets, slots).astype(np.uint16))
            at += 2 * buckets * slots
        return out
