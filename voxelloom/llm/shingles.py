"""Hashed words and weighted word shingles of texts."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

from voxelloom.llm.common import words

#: Words of a shingle; a shorter text is one shingle.
SHINGLE = 5
#: Words that a Python worker remembers.
REMEMBERED = 150_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> bytes:
        found = blake2b(word, digest_size=8).digest()
        if len(self) < REMEMBERED:
            self[word] = found
        return found


_hashes = _Hashes()


#: An odd factor for each place of a run.
_FACTORS = [np.uint64(int.from_bytes(blake2b(b"place %d" % at, digest_size=8).digest(), "little") | 1) for at in range(64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word."""
    return hashed(words(text))


def hashed(own: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each of these words."""
    return np.frombuffer(b"".join(map(_hashes.__getitem__, own)), dtype="<u8")


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words; of all words where there are fewer, nothing where there are none."""
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    n = len(hashes) - size + 1
    out = np.full(n, size, dtype=np.uint64)
    for at in range(size):
        out += hashes[at : at + n] * _FACTORS[at]
    return mixed(out)


def weighted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit shingles, ascending, and how often each occurs."""
    found, counts = np.unique((runs(hashes, SHINGLE) >> np.uint64(32)).astype(np.uint32), return_counts=True)
    return found, counts.astype(np.uint32)


def words_digest(text: str | None) -> bytes | None:
    """128 bits that are equal for texts with the same words; None without words."""
    return digest(words(text))


def digest(own: list[bytes]) -> bytes | None:
    """128 bits that are equal for equal words; None without words."""
    return blake2b(b" ".join(own), digest_size=16).digest() if own else None
