"""A cuckoo filter over 16-byte keys."""

from __future__ import annotations

import numpy as np

SLOTS = 4
#: Moves after which a filter counts as full.
MOVES = 500
#: Share of slots that a new filter has in use at most.
LOAD = 0.6


def capacity_for(keys: int) -> int:
    """Buckets, a power of two, for so many keys."""
    return 1 << max(0, int(np.ceil(keys / (SLOTS * LOAD))) - 1).bit_length()


class CuckooFilter:
    """Membership with deletion: 16-bit fingerprints in one of two buckets each, derived from the key's own bytes.

    A key that was inserted and not deleted is always found; another key is found with a chance of about 8 / 65536.
    """

    def __init__(self, buckets: int, table: bytes | None = None) -> None:
        self.buckets = buckets
        size = buckets * SLOTS
        self.table = np.frombuffer(table, dtype="<u2").copy() if table else np.zeros(size, dtype="<u2")

    def tobytes(self) -> bytes:
        return self.table.tobytes()

    def _homes(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        halves = np.frombuffer(b"".join(keys), dtype="<u8").reshape(-1, 2)
        prints = (halves[:, 1] >> np.uint64(48)).astype(np.int64)
        prints[prints == 0] = 1
        first = (halves[:, 0] >> np.uint64(20)).astype(np.int64) & (self.buckets - 1)
        return prints, first, first ^ self._jump(prints)

    def _jump(self, prints):
        return (prints * 0x5BD1E995 >> 7) & (self.buckets - 1)

    def contains(self, keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.zeros(0, dtype=bool)
        prints, first, second = self._homes(keys)
        rows = self.table.reshape(-1, SLOTS).astype(np.int64)
        return (rows[first] == prints[:, None]).any(axis=1) | (rows[second] == prints[:, None]).any(axis=1)

    def insert(self, keys: list[bytes]) -> bool:
        """Add keys that are not in yet; False if the filter is full, and then it must be built anew, larger."""
        table = self.table.tolist()
        moved = 0
        for print_, first, second in zip(*(x.tolist() for x in self._homes(keys)), strict=True) if keys else ():
            at = first if 0 in table[SLOTS * first : SLOTS * first + SLOTS] else second
            for step in range(MOVES):
                row = table[SLOTS * at : SLOTS * at + SLOTS]
                if 0 in row:
                    table[SLOTS * at + row.index(0)] = print_
                    break
                slot = SLOTS * at + (moved + step) % SLOTS
                print_, table[slot] = table[slot], print_
                at ^= self._jump(print_)
            else:
                return False
            moved += 1
        self.table = np.array(table, dtype="<u2")
        return True

    def delete(self, keys: list[bytes]) -> None:
        """Take out keys that were inserted."""
        table = self.table.tolist()
        for print_, first, second in zip(*(x.tolist() for x in self._homes(keys)), strict=True) if keys else ():
            for at in (first, second):
                row = table[SLOTS * at : SLOTS * at + SLOTS]
                if print_ in row:
                    table[SLOTS * at + row.index(print_)] = 0
                    break
        self.table = np.array(table, dtype="<u2")


def build(keys: list[bytes]) -> CuckooFilter:
    """A filter of all keys, as large as it must be."""
    buckets = capacity_for(len(keys))
    while not (made := CuckooFilter(buckets)).insert(keys):
        buckets *= 2
    return made
