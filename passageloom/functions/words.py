"""Small per-text helpers that run inside Arrow tasks."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate


def window_starts(length: int, size: int, overlap: int) -> range:
    """Start offsets of character windows; none is covered by the one before."""
    step = size - overlap
    return range(0, max(length - overlap, 1), step)


def word_chunks(text: str, size: int, overlap: int) -> list[str]:
    """Chunks of whole words, at most ``size`` long, overlapping by at most ``overlap``."""
    words: list[str] = []
    for word in text.split():
        if len(word) <= size:
            words.append(word)
        else:
            words.extend(word[i : i + size] for i in window_starts(len(word), size, overlap))
    if not words:
        return []
    ends = list(accumulate(map(len, words), lambda end, n: end + 1 + n))
    starts = [end - len(word) for end, word in zip(ends, words)]
    last = len(words) - 1
    chunks, first = [], 0
    while True:
        final = max(first, bisect_right(ends, starts[first] + size) - 1)
        chunks.append(" ".join(words[first : final + 1]))
        if final == last:
            return chunks
        following = bisect_left(starts, ends[final] - overlap)
        first = max(first + 1, min(final + 1, following))


def chunk_links(lengths: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """For every word as the start of a chunk: its last word, and the start of the chunk after it.

    ``lengths`` are those of words of at most ``size``. After a chunk that ends with the last word comes none:
    its next start is the number of words.
    """
    ends = list(accumulate(lengths, lambda end, n: end + 1 + n))
    starts = [end - n for end, n in zip(ends, lengths)]
    last, links = len(lengths) - 1, []
    for first, start in enumerate(starts):
        final = max(first, bisect_right(ends, start + size) - 1)
        following = bisect_left(starts, ends[final] - overlap)
        links.append((final, last + 1 if final == last else max(first + 1, min(final + 1, following))))
    return links


def common_subsequence(left: list[str], right: list[str]) -> int:
    """Length of the longest common subsequence, with one bit per left token."""
    places: dict[str, int] = {}
    for i, token in enumerate(left):
        places[token] = places.get(token, 0) | (1 << i)
    full = (1 << len(left)) - 1
    open_bits = full
    for token in right:
        hit = open_bits & places.get(token, 0)
        if hit:
            open_bits = ((open_bits + hit) | (open_bits - hit)) & full
    return len(left) - open_bits.bit_count()
