"""64-bit hashes of the words of many texts at once."""

from __future__ import annotations

import numpy as np

_SEGMENT = 1 << 21
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _byte_values(lower: bool) -> np.ndarray:
    values = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    if lower:
        values[65:91] = values[97:123]
    return values


_VALUES = {lower: _byte_values(lower) for lower in (False, True)}
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers, modulo 2**64, of an odd base and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, _SEGMENT + 64)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of ``h`` over all bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def prefix_sums(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """Sums from which the hash of any window of ``data`` follows; one longer than ``data``."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[lower][data] * powers(len(data))[0], out=sums[1:])
    return sums


def _segments(data: np.ndarray) -> list[tuple[int, int]]:
    """Cuts at white space, so that a segment is longer than the limit only for a longer word."""
    cuts, start, n = [], 0, len(data)
    while start < n:
        end = min(n, start + _SEGMENT)
        while end < n and not _SPACE[data[end - 1]]:
            end += 1
        cuts.append((start, end))
        start = end
    return cuts


def hash_words(texts: list[str], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, text after text, and where the words of each text start (one more entry than texts).

    Words are runs of anything but ASCII white space; with ``lower``, A-Z count
    as a-z. Temporary memory follows a segment of two megabytes, not the texts.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    lengths = np.array([len(r) + 1 for r in raw], np.int64)
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8) if raw else np.empty(0, np.uint8)
    hashes, starts = [], []
    for begin, end in _segments(data):
        part = data[begin:end]
        blank = np.concatenate([[True], _SPACE[part], [True]])
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        first, last = edges[::2], edges[1::2]
        sums = prefix_sums(part, lower)
        hashes.append(mix((sums[last] - sums[first]) * powers(len(part))[1][first]))
        starts.append(first + begin)
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(raw) + 1, np.int64)
    begins = np.concatenate([[0], np.cumsum(lengths)])
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), begins)


_STEPS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words (at most 5) of one text."""
    size = max(0, len(hashes) - n + 1)
    total = np.full(size, n, np.uint64)
    for i in range(n):
        total += hashes[i : i + size] * _STEPS[i]
    return mix(total)
