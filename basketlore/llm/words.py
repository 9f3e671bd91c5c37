"""Hashes of the words of many texts at once, as numpy arrays.

Words are maximal stretches without ASCII white space, after lower-casing A-Z.
A word's 64-bit hash depends on its bytes only.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

# Bytes hashed in one go; a text is cut at white space only.
PASS_BYTES = 1 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_IS_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_BASE = 0x9E3779B97F4A7C15 | 1


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread over all 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


@lru_cache(maxsize=4)
def _powers(size: int, base: int) -> np.ndarray:
    steps = np.full(size, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def _slices(data: bytes):
    at = 0
    while at < len(data):
        end = at + PASS_BYTES
        found = _SPACE.search(data, end) if end < len(data) else None
        end = found.start() if found else len(data)
        yield at, data[at:end]
        at = end


def hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words in a text of lower-cased bytes."""
    starts, hashes = [], []
    for at, piece in _slices(data):
        codes = np.frombuffer(piece, np.uint8)
        word = np.concatenate(([False], ~_IS_SPACE[codes], [False]))
        edges = np.flatnonzero(word[1:] != word[:-1])
        begin, end = edges[::2], edges[1::2]
        # Differences of a running sum are the words' polynomials, shifted by their place.
        size = PASS_BYTES + (1 << 18)
        while size < codes.size:
            size *= 2
        total = np.zeros(codes.size + 1, np.uint64)
        np.cumsum(_BYTE[codes] * _powers(size, _BASE)[: codes.size], out=total[1:])
        back = _powers(size, pow(_BASE, -1, 1 << 64))[begin] if begin.size else np.empty(0, np.uint64)
        h = (total[end] - total[begin]) * back + (end - begin).astype(np.uint64)
        starts.append(begin + at)
        hashes.append(mixed(h))
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def word_groups(texts):
    """Yield ``(first, count, words, bounds)`` for runs of texts.

    ``words`` are the hashes of all words of the run's texts, those of text i
    from ``bounds[i]`` to ``bounds[i + 1]``.
    """
    first, held, size = 0, [], 0
    for text in texts:
        held.append(text.encode().lower())
        size += len(held[-1]) + 1
        if size >= PASS_BYTES:
            yield first, len(held), *_of_run(held)
            first, held, size = first + len(held), [], 0
    if held:
        yield first, len(held), *_of_run(held)


def _of_run(held):
    starts, words = hash_words(b"\n".join(held))
    ends = np.cumsum([len(t) + 1 for t in held])
    return words, np.concatenate(([0], np.searchsorted(starts, ends))).astype(np.int64)
