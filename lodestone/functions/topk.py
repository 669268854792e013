"""The first k hits of many rows, kept while batches of hits go by."""

from __future__ import annotations

import numpy as np


class Best:
    """For each of n rows the k hits with the largest score, of equal ones those that came first; each hit carries a value."""

    def __init__(self, n: int, k: int):
        self.k, self.seen = k, 0
        self.scores, self.order, self.values = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max), np.empty((n, k), object)

    def add(self, scores: np.ndarray, values: np.ndarray) -> None:
        """Add a batch: scores of every row with each of its members, whose values are given in the order that ties go by."""
        better = scores > self.scores[:, -1][:, None]  # a tie with the last one came later than that
        if scores.shape[1] > self.k and self.seen < 4 * self.k:  # while little is held nearly all would pass: of a batch, only its own k best can
            better &= scores >= np.partition(scores, -self.k, axis=1)[:, -self.k][:, None]
        rows, at = np.nonzero(better)
        if len(rows):
            got = scores[rows, at]
            own = np.unique(rows)
            rows = np.concatenate([rows, np.repeat(own, self.k)])
            got, order = np.concatenate([got, self.scores[own].ravel()]), np.concatenate([at + self.seen, self.order[own].ravel()])
            held = np.concatenate([values[at], self.values[own].ravel()])
            sort = np.lexsort((order, -got, rows))
            rows, got, order, held = rows[sort], got[sort], order[sort], held[sort]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            kept = place < self.k
            to = rows[kept], place[kept]
            self.scores[to], self.order[to], self.values[to] = got[kept], order[kept], held[kept]
        self.seen += scores.shape[1]

    def held(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, value, score) of all hits."""
        rows, place = np.nonzero(self.scores > -np.inf)
        return rows, self.values[rows, place], self.scores[rows, place]
