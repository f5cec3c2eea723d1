"""A geometric near-neighbour access tree over integer points, searched for many queries at once."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

DEGREE, LEAF = 8, 8
#: Roots and sums of a few doubles are right to far better than this share.
SLACK = 1e-12


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of a to all rows of b as int64.

    Products in doubles where every partial sum is an integer below 2^53, otherwise in 64-bit integers.
    """
    top = float(max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)))
    if 4 * top * top * max(a.shape[1], 1) < 2.0**53:
        x, y = a.astype(np.float64), b.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None, :]).astype(np.int64)
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    for i in range(a.shape[1]):
        step = a[:, i, None] - b[None, :, i]
        out += step * step
    return out


@dataclass
class Node:
    """Split points, and for each split point the range of its distances to each child with its split point."""

    splits: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    children: list["Node | None"] = field(default_factory=list)


class Gnat:
    """Nearest points with ties to the lower index.

    A child is eliminated only if the distance bounds put all its points strictly farther than the best
    one so far; bounds are rounded away from elimination and winners are compared as integers, so no tie is lost.
    """

    def __init__(self, points: np.ndarray):
        self.points = np.asarray(points, dtype=np.int64)
        self.root = self._built(np.arange(len(self.points)))
        self.eliminated = self.visited = 0  # children of (query, node)

    def _built(self, rows: np.ndarray) -> Node:
        if len(rows) <= LEAF:
            return Node(rows)
        splits = [int(rows[0])]
        nearest = squared(self.points[rows], self.points[rows[:1]])[:, 0]
        while len(splits) < DEGREE:  # the farthest from those chosen; copies of a chosen point come last
            free = np.where(np.isin(rows, splits), -1, nearest)
            at = int(free.argmax())
            splits.append(int(rows[at]))
            nearest = np.minimum(nearest, squared(self.points[rows], self.points[rows[at : at + 1]])[:, 0])
        chosen = np.array(splits)
        rest = rows[~np.isin(rows, chosen)]
        far = squared(self.points[chosen], self.points[rest])
        home = far.argmin(0)
        low = np.sqrt(squared(self.points[chosen], self.points[chosen]))
        high = low.copy()
        children: list[Node | None] = []
        for j in range(DEGREE):
            mine = home == j
            if not mine.any():
                children.append(None)
                continue
            reach = np.sqrt(far[:, mine])
            low[:, j] = np.minimum(low[:, j], reach.min(1))
            high[:, j] = np.maximum(high[:, j], reach.max(1))
            children.append(self._built(rest[mine]))
        return Node(chosen, low * (1 - SLACK), high * (1 + SLACK), children)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest point of each query."""
        queries = np.asarray(queries, dtype=np.int64)
        best = np.full(len(queries), np.iinfo(np.int64).max)
        index = np.full(len(queries), len(self.points))
        self._visit(self.root, queries, np.arange(len(queries)), best, index)
        return index, best

    def _visit(self, node: Node, queries: np.ndarray, rows: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        if not len(node.splits):
            return
        order = np.sort(node.splits)  # argmin takes the lower index of a tie
        exact = squared(queries[rows], self.points[order])
        at = exact.argmin(1)
        found, name = exact[np.arange(len(rows)), at], order[at]
        better = (found < best[rows]) | ((found == best[rows]) & (name < index[rows]))
        best[rows[better]], index[rows[better]] = found[better], name[better]
        if node.low is None:
            return
        away = np.sqrt(exact[:, np.searchsorted(order, node.splits)])
        near, far = away * (1 - SLACK), away * (1 + SLACK)
        for j, child in enumerate(node.children):
            if child is None:
                continue
            radius = np.sqrt(best[rows]) * (1 + SLACK)
            gone = ((near - radius[:, None] > node.high[:, j]) | (far + radius[:, None] < node.low[:, j])).any(1)
            self.eliminated += int(gone.sum())
            self.visited += int((~gone).sum())
            if not gone.all():
                self._visit(child, queries, rows[~gone], best, index)
