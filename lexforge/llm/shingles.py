"""Word shingles of whole batches of texts as 64-bit hashes, in numpy passes over one code-point array."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's): every input bit moves every output bit."""
    x = x + _M1
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _word_points() -> np.ndarray:
    """True for each code point that is a letter or a digit."""
    table = np.zeros(0x110000, bool)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] in "LN":
            table[c] = True
    return table


def shingle_hashes(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): text i has the shingles hashes[offsets[i]:offsets[i + 1]], in order and with repeats.

    Words are the longest runs of letters and digits, in lower case; a shingle is `width` successive words. A text with fewer words has
    none. Null counts as empty. The hash depends on the words alone, so it is the same on every machine.
    """
    joined = "\n".join(t.lower().replace("\n", " ") if t else "" for t in texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _word_points()[points]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    text_ends = np.flatnonzero(points == 10)
    words_upto = np.searchsorted(starts, text_ends)  # words before each text's end
    if not len(starts):
        return np.zeros(len(texts) + 1, np.int64), np.empty(0, np.uint64)
    at = np.flatnonzero(inside)
    place = np.arange(len(at)) - np.repeat(np.cumsum(ends - starts) - (ends - starts), ends - starts)
    letters = mix(points[at].astype(np.uint64) + (place.astype(np.uint64) << np.uint64(21)))
    words = mix(np.add.reduceat(letters, np.cumsum(ends - starts) - (ends - starts)))
    n = len(words)
    rolled = words.copy()
    for i in range(1, width):
        rolled[: n - i] = mix(rolled[: n - i] * _M3 + words[i:])
    first = np.concatenate(([0], words_upto[:-1]))
    counts = np.maximum(words_upto - first - (width - 1), 0)
    offsets = np.concatenate(([0], np.cumsum(counts)))
    take = np.arange(offsets[-1]) + np.repeat(first - offsets[:-1], counts)
    return offsets, rolled[take]
