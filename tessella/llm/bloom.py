"""Bloom filters over 64-bit hashes in numpy, growing with what is put in."""

from __future__ import annotations

import numpy as np

PROBES = 4
#: Places (8 bytes each) of the table of reported hashes.
REPORTED = 1 << 17
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads its bits."""
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def probes(hashes: np.ndarray, bits: int):
    """The PROBES places of each hash among so many bits, a power of two."""
    start = mix64(hashes)  # the hashes of a shard share their low bits
    step = (start >> np.uint64(32)) | np.uint64(1)
    for k in range(PROBES):
        yield (start + np.uint64(k) * step) & np.uint64(bits - 1)


class Bloom:
    """A chain of filters, each twice as large as the one before: about 12 bits and 4 probes an entry, without a size known ahead."""

    def __init__(self, capacity: int = 1 << 16):
        self.parts: list[np.ndarray] = []
        self.capacity, self.room = capacity, 0

    @classmethod
    def of(cls, bits: bytes) -> Bloom:
        """The filter with these bits, for lookups."""
        found = cls()
        found.parts = [np.frombuffer(bits, np.uint8)] if bits else []
        return found

    def _at(self, part: np.ndarray, hashes: np.ndarray):
        for at in probes(hashes, 8 * len(part)):
            yield at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.zeros(len(hashes), bool)
        for part in self.parts:
            here = np.ones(len(hashes), bool)
            for byte, bit in self._at(part, hashes):
                here &= (part[byte] & bit) != 0
            found |= here
        return found

    def add(self, hashes: np.ndarray) -> None:
        while len(hashes):
            if self.room <= 0:
                self.parts.append(np.zeros(self.capacity * 2, np.uint8))
                self.room, self.capacity = self.capacity, self.capacity * 2
            now, hashes = hashes[: self.room], hashes[self.room :]
            self.room -= len(now)
            for byte, bit in self._at(self.parts[-1], now):
                np.bitwise_or.at(self.parts[-1], byte, bit)


class TwiceSeen:
    """A Bloom filter of what was seen, and an exact table of fixed size with what was reported last at each of its places.

    A false positive of the filter reports a hash too many. A report is left out only for a hash that stands in the table itself, so
    none is lost; a hash whose place another one took is reported again.
    """

    def __init__(self, places: int = REPORTED):
        self.once, self.reported = Bloom(), np.zeros(places, np.uint64)

    def repeats(self, hashes: np.ndarray) -> np.ndarray:
        """Of these hashes the ones seen before, each reported at least once over the life of the filter."""
        values, counts = np.unique(hashes, return_counts=True)
        again = self.once.has(values) | (counts > 1)
        self.once.add(values[~again | (counts > 1)])
        suspects = values[again]
        at = mix64(suspects) % np.uint64(len(self.reported))
        new = (self.reported[at] != suspects) | (suspects == 0)  # 0 marks a free place
        self.reported[at[new]] = suspects[new]
        return suspects[new]
