"""Vectorised word hashes over UTF-8 bytes, for use inside tasks."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

#: Byte classes: [0-9a-z] and every byte of a non-ASCII character; and everything but ASCII white space.
ALNUM = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
NON_SPACE = np.array([b not in (32, 9, 10, 11, 12, 13) for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return run(_BASE), run(_BASE_INVERSE)


def word_spans(data: bytes, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the maximal runs of bytes of the class `inside`."""
    flags = np.zeros(len(data) + 2, np.int8)
    flags[1:-1] = inside[np.frombuffer(data, np.uint8)]
    steps = np.diff(flags)
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def span_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from prefix sums of a polynomial."""
    n = 1 << max(19, (len(data) + 1).bit_length())
    up, down = _powers(n)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive word hashes."""
    m = max(0, len(words) - n + 1)
    out = np.full(m, n, np.uint64)
    for j in range(n):
        out = mix(out * np.uint64(_BASE) + words[j : j + m])
    return out


def slices(sizes: list[int], limit: int = 1 << 19):
    """Index ranges of consecutive texts of about limit bytes together; a larger text stands alone."""
    lo = at = 0
    for i, n in enumerate(sizes):
        if at and at + n > limit:
            yield lo, i
            lo, at = i, 0
        at += n
    if lo < len(sizes):
        yield lo, len(sizes)
