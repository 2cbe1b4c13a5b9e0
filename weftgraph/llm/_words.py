"""Words of many texts at once, in numpy: places, 64-bit hashes and hashes of runs of words."""

from __future__ import annotations

import numpy as np

#: Separators of plain words: space and \\t to \\r.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
#: Separators of normalized words: every ASCII byte that is no letter or digit.
PUNCT = np.ones(256, dtype=bool)
PUNCT[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for i, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, b, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all input bits (the splitmix64 finalizer)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[start:end] for each range."""
    power, inverse = _tables(len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * power[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts])


class Words:
    """`first[d]:first[d + 1]` are the words of document d; word i is `buffer[starts[i]:ends[i]]`."""

    def __init__(self, raws: list[bytes], separators: np.ndarray = SPACE):
        self.raw = b" ".join([b"", *raws, b""])
        self.buffer = np.frombuffer(self.raw, dtype=np.uint8)
        gap = separators[self.buffer]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        self.starts, self.ends = edge[0::2], edge[1::2]
        sizes = np.array([0, *map(len, raws)], dtype=np.int64) + 1
        self.first = np.searchsorted(self.starts, np.cumsum(sizes))
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return ranges(_BYTE[self.buffer], self.starts, self.ends)

    def word(self, i: int) -> bytes:
        return self.raw[self.starts[i] : self.ends[i]]

    def joined(self, begin: int, end: int) -> bytes:
        """Words begin to end - 1 with one space between."""
        return b" ".join(self.raw[self.starts[begin] : self.ends[end - 1]].split()) if end > begin else b""

    def documents(self) -> np.ndarray:
        """Document of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of words i to i + k - 1 for every i; runs that cross a document's end are the caller's to drop."""
    n = max(0, len(hashes) - k + 1)
    at = np.arange(n)
    return ranges(hashes, at, at + k)


def run_starts(counts: np.ndarray, k: int) -> np.ndarray:
    """Mask over all words: does a run of k words of one document start here?"""
    left = np.repeat(np.cumsum(counts), counts) - np.arange(int(counts.sum()))
    return left >= k
