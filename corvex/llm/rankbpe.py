"""Byte-pair encoding by a contiguous rank array, with the public vocabularies as files.

A word is held as its part boundaries and, beside them, the rank of every pair of adjacent parts. The lowest rank is
looked for by a scan, its inner boundary deleted and the two neighbouring ranks refreshed, until no pair has a rank.
Scans are quadratic in the word, so words beyond ``SHORT_BYTES`` use a heap over linked parts, which merges in the same
order (lowest rank, then leftmost) and gives the same ids.
"""

from __future__ import annotations

import base64
import heapq
import importlib
import os
import re

import regex

# The published pre-tokenisation pattern of the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The same for texts of ASCII only; \s of a str pattern would also take the separators \x1c to \x1f.
ASCII = r"""'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"""

SHORT_BYTES = 256
CACHE_WORDS = 200_000
NONE = 1 << 60

_split_any = regex.compile(PATTERN)
_split_ascii = re.compile(ASCII)
_loaded: dict[str, "RankEncoder"] = {}


def vocabulary(name: str, folder: str | None = None) -> str:
    """Path of a public vocabulary's rank file; ``folder`` overrides the installed place."""
    if folder is None:
        folder = os.path.dirname(importlib.import_module("public_tokenizers").__file__)
    return os.path.join(folder, f"{name}.tiktoken")


class RankEncoder:
    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(k): int(v) for k, v in map(bytes.split, lines)}
        self.cache: dict[str, tuple[int, ...]] = {}

    def word(self, word: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(word)
        if whole is not None:
            return (whole,)
        return self._scan(word) if len(word) <= SHORT_BYTES else self._heap(word)

    def _scan(self, word: bytes) -> tuple[int, ...]:
        rank = self.ranks.get
        bounds = list(range(len(word) + 1))
        pairs = [rank(word[i : i + 2], NONE) for i in range(len(word) - 1)]
        while pairs and (lowest := min(pairs)) != NONE:
            i = pairs.index(lowest)
            del bounds[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = rank(word[bounds[i] : bounds[i + 2]], NONE)
            if i:
                pairs[i - 1] = rank(word[bounds[i - 1] : bounds[i + 1]], NONE)
        return tuple(self.ranks[word[a:b]] for a, b in zip(bounds, bounds[1:]))

    def _heap(self, word: bytes) -> tuple[int, ...]:
        n, rank = len(word), self.ranks.get
        end = list(range(1, n + 1))  # end of the part that begins at i; 0 once it is merged away
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue  # one of the two parts has changed since
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := rank(word[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (j := before[i]) >= 0 and (r := rank(word[j:stop])) is not None:
                heapq.heappush(heap, (r, j, stop))
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[word[i : end[i]]])
            i = end[i]
        return tuple(ids)

    def words(self, text: str) -> list[str]:
        return (_split_ascii if text.isascii() else _split_any).findall(text)

    def _look_up(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        for w in set(words):
            if w not in cache:
                cache[w] = self.word(w.encode("utf-8", "surrogatepass"))
        return cache

    def extend(self, out: list[int], text: str | None) -> None:
        """Append the ids of ``text`` to ``out``."""
        if text:
            words = self.words(text)
            cache = self._look_up(words)
            for w in words:
                out += cache[w]

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        self.extend(out, text)
        return out

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        words = self.words(text)
        cache = self._look_up(words)
        return sum(len(cache[w]) for w in words)


def encoder(path: str) -> RankEncoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _loaded:
        _loaded[path] = RankEncoder(path)
    return _loaded[path]
