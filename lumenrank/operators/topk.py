"""Running top-k lists inside a task, with the rounding and ties of the final ranking."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np

DECIMALS = 9
SLACK = 2e-9        # scores further apart than this are still apart after rounding


def rounded(x: np.ndarray, decimals: int = DECIMALS) -> np.ndarray:
    """Half-up decimal rounding of doubles, value for value what Spark's ``round`` gives."""
    scale = 10.0 ** decimals
    y = np.asarray(x, np.float64) * scale
    out = np.round(y) / scale
    near_half = np.abs(np.abs(y - np.floor(y)) - 0.5) < 1e-4
    if near_half.any():
        values, back = np.unique(np.asarray(x)[near_half], return_inverse=True)
        unit = Decimal(1).scaleb(-decimals)
        out[near_half] = np.array([float(Decimal(repr(float(v))).quantize(unit, ROUND_HALF_UP)) for v in values])[back]
    return out + 0.0    # no negative zero


class RunningTopK:
    """The best ``k`` of each of ``n`` lists: score descending, then id ascending.

    ``least[i]`` is the score that a new entry of list i has to reach (minus infinity
    while the list is short).  Memory is n * k entries, whatever is offered.
    """

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, -np.inf)
        self.lists: dict[int, list[tuple[float, str]]] = {}

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Add entries (list number, rounded score, id)."""
        good = scores >= self.least[rows]
        rows, scores, ids = rows[good], scores[good], ids[good]
        if not len(rows):
            return
        order = np.argsort(rows, kind="stable")
        rows, scores, ids = rows[order], scores[order], ids[order]
        ends = np.flatnonzero(np.append(rows[1:] != rows[:-1], True)) + 1
        start = 0
        for end in ends.tolist():
            i = int(rows[start])
            merged = self.lists.get(i, []) + list(zip((-scores[start:end]).tolist(), ids[start:end].tolist()))
            merged.sort()
            del merged[self.k:]
            self.lists[i] = merged
            if len(merged) == self.k:
                self.least[i] = -merged[-1][0]
            start = end

    def rows(self):
        """(list number, id, score) of all entries."""
        for i, entries in self.lists.items():
            for score, name in entries:
                yield i, name, -score
