"""The best rows of many queries inside a task, kept while rows pass by."""

from __future__ import annotations

import numpy as np

#: Offers that wait at least before they are put in order.
WAITING = 500_000


class Best:
    """The k rows of the highest score of each of n queries; ties go to the lower id.

    `edge` has, for each query, the least score that can still get in. Rows are
    offered as parallel arrays and put in order when as many wait as are kept.
    """

    def __init__(self, n: int, k: int, least: float = -np.inf):
        self.k, self.edge = k, np.full(n, least, np.float64)
        self.kept = (np.zeros(0, np.int64), np.zeros(0, np.float64), np.zeros(0, np.int64))
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.count = 0

    def offer(self, query: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        in_time = score >= self.edge[query]
        self.waiting.append((query[in_time], score[in_time], row[in_time]))
        self.count += int(in_time.sum())
        if self.count > max(WAITING, len(self.kept[0])):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, row) of what is kept, by query, best first."""
        if self.waiting:
            query, score, row = (np.concatenate(x) for x in zip(self.kept, *self.waiting))
            order = np.lexsort((row, -score, query))
            query, score, row = query[order], score[order], row[order]
            place = places(query)
            keep, last = place < self.k, place == self.k - 1
            self.edge[query[last]] = score[last]
            self.kept = query[keep], score[keep], row[keep]
            self.waiting, self.count = [], 0
        return self.kept


def places(groups: np.ndarray) -> np.ndarray:
    """Place of each element in its run of equal ones, from 0."""
    at = np.arange(len(groups))
    first = np.ones(len(groups), bool)
    first[1:] = groups[1:] != groups[:-1]
    return at - np.maximum.accumulate(np.where(first, at, 0))
