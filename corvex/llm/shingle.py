"""Sets of word runs as 64-bit hashes, for many texts at once, in numpy.

A word is a longest run of ASCII letters, digits and ``_``, lower-cased; a shingle is ``width`` consecutive words.
"""

from __future__ import annotations

import numpy as np

from corvex.llm.rolling import Rolling, mix

_WORD = np.zeros(256, bool)
_LOWER = np.arange(256, dtype=np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_":
    _WORD[_c] = True
    _LOWER[_c] = ord(chr(_c).lower())


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and where each text's words begin (one more entry than texts)."""
    raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[1:] = _WORD[raw]
    edge = np.diff(inside)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    hashes = Rolling(_LOWER[raw]).at(begin, end - begin)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return hashes, np.searchsorted(begin, np.concatenate([[0], np.cumsum(sizes)]))


def shingle_sets(texts: list[bytes], width: int = 3) -> tuple[list[np.ndarray], np.ndarray]:
    """For each text the sorted distinct hashes of its shingles (none if it has fewer words), and its number of words."""
    words, first = word_hashes(texts)
    m = max(0, len(words) - width + 1)
    h = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + words[i : i + m])
    return [np.unique(h[a : max(a, b - width + 1)]) for a, b in zip(first, first[1:])], np.diff(first)
