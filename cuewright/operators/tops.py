"""The best k of each of many queries, gathered from blocks of scores inside a task."""

from __future__ import annotations

import numpy as np

#: Digits that scores are rounded to before they are ranked, so that the order of a sum does not decide a rank.
DIGITS = 6
#: Groups of a block's columns for each of the best k, whose maxima tell the least score that can still matter.
GROUPS = 16


class Best:
    """Rounded scores and ids of n queries, best first, ties to the smaller id. With positive only scores above 0 count."""

    def __init__(self, n: int, k: int, positive: bool = False) -> None:
        self.k, self.least = k, 10.0**-DIGITS if positive else -np.inf
        self.score, self.own = np.full((n, k), -np.inf), np.zeros((n, k), np.int64)

    def offer(self, first: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of the queries from first on (rows) with ids in ascending order (columns)."""
        (rows, columns), k = scores.shape, self.k
        mine = slice(first, first + rows)
        floor = np.maximum(self.score[mine, -1], self.least)
        if columns >= 2 * GROUPS * k:
            # k groups of columns have a maximum of so much, so the k-th best of the row is no less.
            whole = columns // (GROUPS * k)
            most = np.fmax.reduce(scores[:, : whole * GROUPS * k].reshape(rows, whole, -1), axis=1)
            floor = np.fmax(floor, np.round(np.partition(most, GROUPS * k - k, axis=1)[:, GROUPS * k - k], DIGITS))
        # What rounds up to the floor is at most half a digit below it.
        at = np.flatnonzero(scores >= (floor - 0.6 * 10.0**-DIGITS)[:, None])
        row, told = at // columns, np.round(scores.ravel()[at], DIGITS)
        good = told >= (floor - 0.1 * 10.0**-DIGITS)[row]
        row, told, own = row[good], told[good], ids[(at % columns)[good]]
        if not len(row):
            return
        old, place = np.nonzero(self.score[mine] > -np.inf)
        row, told, own = np.concatenate((old, row)), np.concatenate((self.score[mine][old, place], told)), np.concatenate((self.own[mine][old, place], own))
        line = np.lexsort((own, -told, row))
        row, told, own = row[line], told[line], own[line]
        place = np.arange(len(row)) - np.searchsorted(row, np.arange(rows))[row]
        kept = place < k
        self.score[mine][row[kept], place[kept]], self.own[mine][row[kept], place[kept]] = told[kept], own[kept]

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of all that are left, by the query's number."""
        row, place = np.nonzero(self.score > -np.inf)
        return row, self.own[row, place], self.score[row, place]
