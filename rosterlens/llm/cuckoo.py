"""A cuckoo filter over 64-bit hashes: approximate membership that allows deletion."""

from __future__ import annotations

import numpy as np

SLOTS, KICKS = 4, 500
_MIX = np.uint64(0x9E3779B97F4A7C15)


class CuckooFilter:
    """Four 16-bit marks a bucket, two buckets a key; never misses a key that is in it."""

    def __init__(self, keys: int = 0, table: np.ndarray | None = None):
        if table is None:
            buckets = 1
            while buckets * SLOTS * 0.85 < keys + 1:
                buckets *= 2
            table = np.zeros((buckets, SLOTS), dtype=np.uint16)
        self.table = table
        self.mask = np.uint64(len(table) - 1)

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marks (never zero) and both buckets of each hash."""
        h = np.asarray(hashes, dtype=np.uint64)
        marks = (h >> np.uint64(48)).astype(np.uint16)
        marks[marks == 0] = 1
        first = h & self.mask
        return marks, first, first ^ self.shift(marks)

    def shift(self, marks: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((marks.astype(np.uint64) * _MIX) >> np.uint64(20)) & self.mask

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        marks, a, b = self.places(hashes)
        return (self.table[a] == marks[:, None]).any(axis=1) | (self.table[b] == marks[:, None]).any(axis=1)

    def insert(self, hashes: np.ndarray) -> bool:
        """False if there is no room left; the filter is then to be built anew, with more buckets."""
        marks, first, second = (x.tolist() for x in self.places(hashes))
        for mark, a, b in zip(marks, first, second):
            at = a if not self.table[a].all() else b
            for kick in range(KICKS):
                row = self.table[at]
                free = np.flatnonzero(row == 0)
                if len(free):
                    row[free[0]] = mark
                    break
                mark, row[kick % SLOTS] = int(row[kick % SLOTS]), mark
                at = int(at ^ int(self.shift(np.array([mark], dtype=np.uint16))[0]))
            else:
                return False
        return True

    def delete(self, hashes: np.ndarray) -> None:
        """Take out keys that were inserted."""
        marks, first, second = (x.tolist() for x in self.places(hashes))
        for mark, a, b in zip(marks, first, second):
            for at in (a, b):
                found = np.flatnonzero(self.table[at] == mark)
                if len(found):
                    self.table[at, found[0]] = 0
                    break
            else:
                raise KeyError("a key to delete is not in the filter")

    def to_bytes(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        return cls(table=np.frombuffer(raw, dtype="<u2").reshape(-1, SLOTS).copy())

    @classmethod
    def of(cls, hashes: np.ndarray) -> CuckooFilter:
        """A filter of these keys, as large as it must be."""
        room = len(hashes)
        while True:
            made = cls(room)
            if made.insert(hashes):
                return made
            room = 2 * room + SLOTS
