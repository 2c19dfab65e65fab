"""Words of texts as 64-bit hashes, in numpy, for use inside tasks.

A word is a run of characters other than the six ASCII white-space characters; texts
are taken as UTF-8 bytes, whose ``split`` knows exactly these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

#: Words whose hashes a worker remembers before it starts anew.  With the words of a chunk (a few bytes
#: objects, and some ten arrays of 8 bytes a word) a worker holds about 20 MB of them.
REMEMBERED = 50_000
#: Words that are worked on together; a text is never cut, so one text may be more.
CHUNK_WORDS = 40_000
#: Odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """word -> 64-bit hash, filled on demand and bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def chunks(texts, lower: bool = False) -> Iterator[list[list[bytes]]]:
    """The words of the texts, in groups of texts with about CHUNK_WORDS words."""
    held: list[list[bytes]] = []
    total = 0
    for text in texts:
        raw = (text or "").encode("utf-8", "replace")
        words = (raw.lower() if lower else raw).split()  # bytes.lower changes A-Z only
        held.append(words)
        total += len(words)
        if total >= CHUNK_WORDS:
            yield held
            held, total = [], 0
    if held:
        yield held


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, as many as were asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << int(n - 1).bit_length()
            ups, downs = (np.full(size, x, dtype=np.uint64) for x in (BASE, pow(BASE, -1, 1 << 64)))
            ups[0] = downs[0] = 1
            self.up, self.down = np.cumprod(ups), np.cumprod(downs)
        return self.up[:n], self.down[:n]


class Spans:
    """Hashes of any spans of a sequence of word hashes, in constant time each."""

    def __init__(self, hashes: np.ndarray, powers: Powers):
        up, self.down = powers.get(len(hashes) + 1)
        self.sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(hashes * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def grams(self, n: int) -> np.ndarray:
        """All spans of n words."""
        return mix((self.sums[n:] - self.sums[:-n]) * self.down[:len(self.sums) - n] + np.uint64(n))


def sliding(x: np.ndarray, size: int, f=np.minimum) -> np.ndarray:
    """f over every ``size`` neighbours, by doubling."""
    done = 1
    while done * 2 <= size:
        x = f(x[:-done], x[done:])
        done *= 2
    return x if done == size else f(x[:-(size - done)], x[size - done:])
