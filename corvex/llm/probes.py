"""p-stable hashing of vectors and the order in which perturbed buckets are visited."""

from __future__ import annotations

import heapq

import numpy as np

from corvex.llm.rolling import mix


def templates(functions: int, probes: int) -> list[list[int]]:
    """Perturbation sets over the 2M boundaries sorted by distance, in rising expected score; a set doesn't hold both
    boundaries of one function (j and 2M-1-j). Expected squared distances are those of uniform places in a bucket."""
    m = functions
    score = [(j + 1) * (j + 2) / (4 * (m + 1) * (m + 2)) if j < m else 1 - (2 * m - j) / (m + 1) + (2 * m - j) * (2 * m - j + 1) / (4 * (m + 1) * (m + 2)) for j in range(2 * m)]
    out, heap = [], [(score[0], [0])]
    while heap and len(out) < probes:
        total, s = heapq.heappop(heap)
        if not any(2 * m - 1 - j in s for j in s):
            out.append(s)
        last = s[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (total - score[last] + score[last + 1], s[:-1] + [last + 1]))
            heapq.heappush(heap, (total + score[last + 1], [*s, last + 1]))
    return out


class Hashing:
    def __init__(self, dim: int, functions: int, width: float, tables: int, probes: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.m, self.width, self.tables = functions, width, tables
        self.a = rng.standard_normal((dim, tables * functions))
        self.b = rng.uniform(0, width, tables * functions)
        self.weights = rng.integers(1, 1 << 62, tables * functions, dtype=np.int64).astype(np.uint64) | np.uint64(1)
        self.templates = templates(functions, probes)

    def keys(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket keys of unit vectors x: home[n, tables], and probe[n, tables, probes] in order of expected success."""
        n, m = len(x), self.m
        at = (x @ self.a + self.b) / self.width
        cell = np.floor(at)
        frac = (at - cell).reshape(n, self.tables, m)
        with np.errstate(over="ignore"):
            terms = (cell.astype(np.int64).astype(np.uint64) * self.weights).reshape(n, self.tables, m)
            sums = terms.sum(2, dtype=np.uint64) + np.arange(self.tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            order = np.argsort(np.concatenate([frac, 1 - frac], axis=2), axis=2, kind="stable")
            w = self.weights.reshape(1, self.tables, m)
            # A step of -1 across the lower boundary, of +1 across the upper one.
            step = np.concatenate([np.broadcast_to(np.uint64(0) - w, (n, self.tables, m)), np.broadcast_to(w, (n, self.tables, m))], axis=2)
            step = np.take_along_axis(step, order, axis=2)
            probes = np.stack([sums + step[:, :, t].sum(2, dtype=np.uint64) for t in self.templates], axis=2) if self.templates else np.zeros((n, self.tables, 0), np.uint64)
        return mix(sums), mix(probes)
