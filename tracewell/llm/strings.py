"""Vectorized hashing of UTF-8 texts: words, shingles and any substrings of a byte array."""

from __future__ import annotations

import hashlib

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_FACTOR = np.uint64(0xD6E8FEB86659FD93)
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)

#: Bytes hashed with one table of powers; longer words are hashed by a digest.
SEGMENT = 1 << 20
LONG_WORD = 1 << 16

# The six white-space bytes that end a word.
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * _FACTOR
    x ^= x >> np.uint64(29)
    x *= _ODD
    x ^= x >> np.uint64(32)
    return x


BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of an odd number, and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        up, down = np.full(n, _ODD), np.full(n, np.uint64(pow(int(_ODD), -1, 1 << 64)))
        up[0] = down[0] = 1
        _POWERS[:] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[0], _POWERS[1]


class PrefixHash:
    """64-bit hashes of substrings of a byte array, from sums of its prefixes."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(max(len(data), SEGMENT) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def every(self, width: int) -> np.ndarray:
        """Of the substring of that width at each start."""
        n = len(self.sums) - width
        return mixed((self.sums[width:] - self.sums[:n]) * self.down[:n])


def words(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, and each text's number of words.

    Words are the longest runs without the bytes 0x20 and 0x09 to 0x0D, with A-Z lower-cased.
    """
    gap = b"\n"
    data = np.frombuffer(gap + gap.join(bodies) + gap, np.uint8)
    blank = _GAP[data]
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    stops = np.cumsum([len(b) + 1 for b in bodies])
    counts = np.diff(np.searchsorted(starts, stops), prepend=0)
    return word_hashes(_LOWER[data], starts, ends), counts


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the whole words of ``data`` from each start to each end."""
    hashes = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        # Words that end within the segment, or the first one alone.
        last = max(at + 1, int(np.searchsorted(ends, starts[at] + SEGMENT, "right")))
        first, end = int(starts[at]), int(ends[last - 1])
        if end - first <= SEGMENT:
            hashes[at:last] = PrefixHash(data[first:end]).of(starts[at:last] - first, ends[at:last] - first)
        at = last
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        hashes[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return hashes


def pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of ordered pairs of hashes."""
    return mixed(left * _FACTOR + mixed(right * _SECOND))


def shingle_sets(bodies: list[bytes], width: int = 2) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of ``width`` words.

    A text of fewer words has one shingle, all its words; a text without words none.
    """
    hashes, counts = words(bodies)
    out, at = [], 0
    for n in counts.tolist():
        own = hashes[at : at + n]
        at += n
        if n:
            size = min(width, n)
            joined = own[: n - size + 1]
            for k in range(1, size):
                joined = pairs(joined, own[k : n - size + 1 + k])
            own = np.unique(joined if size == width else mixed(joined + np.uint64(size)))
        out.append(own)
    return out


def batches_of(bodies: list[bytes], most: int) -> list[slice]:
    """Slices of texts of about ``most`` bytes; a longer text is alone."""
    out, start, size = [], 0, 0
    for i, body in enumerate(bodies):
        if i > start and size + len(body) > most:
            out.append(slice(start, i))
            start, size = i, 0
        size += len(body)
    return [*out, slice(start, len(bodies))] if bodies else []
