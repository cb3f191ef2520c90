"""The nearest point of smaller rank: a numpy helper on the points of one tile."""

from __future__ import annotations

import numpy as np

#: Halvings of the radius at most, points that a cell of the finest grid should hold at most, and pairs that are looked at at a time.
HALVINGS, FEW, PAIRS = 10, 8, 1_000_000


def _cells(x: np.ndarray, y: np.ndarray, side: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Numbers of cells of a grid, with an empty border, so that neighbours have numbers too; and the length of a row."""
    i, j = np.floor(x / side).astype(np.int64), np.floor(y / side).astype(np.int64)
    i, j = i - i.min() + 1, j - j.min() + 1
    row = int(j.max()) + 2
    return i * row + j, i, row


def nearest_before(x: np.ndarray, y: np.ndarray, rank: np.ndarray, asked: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """For each of the points ``asked``, distance and number of the nearest point of smaller rank nearer than ``radius``, ties to the smallest rank; infinity and -1 if none.

    Grids go from fine to coarse. Who finds one within a cell's width is done; the others stand that far from each other, so that few of them are left around any point
    when cells get wider, and the pairs grow with the points. Of points at one place only that of the smallest rank is met.
    """
    distance, before = np.full(len(x), np.inf), np.full(len(x), -1, np.int64)
    order = np.lexsort((rank, y, x))
    new = np.ones(len(x), bool)
    new[1:] = (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])
    heads = order[new]
    first = np.empty(len(x), np.int64)
    first[order] = heads[np.cumsum(new) - 1]
    beside = asked[first[asked] != asked]
    distance[beside], before[beside] = 0.0, first[beside]
    todo = asked[first[asked] == asked]
    halvings = 0
    while halvings < HALVINGS and np.unique(_cells(x[heads], y[heads], radius / 2**halvings)[0], return_counts=True)[1].max() > FEW:
        halvings += 1
    for k in range(halvings, -1, -1):
        if not len(todo):
            break
        side = radius / 2**k
        cell, _, row = _cells(x[heads], y[heads], side)
        by_cell = np.argsort(cell, kind="stable")
        ordered, members = cell[by_cell], heads[by_cell]
        own = np.empty(len(x), np.int64)
        own[heads] = cell
        for i in (-1, 0, 1):
            # The three cells of a column follow one another.
            low = np.searchsorted(ordered, own[todo] + i * row - 1, "left")
            many = np.searchsorted(ordered, own[todo] + i * row + 1, "right") - low
            ends = np.cumsum(many)
            start = 0
            while start < len(todo):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right")))
                _meet(x, y, rank, todo[start:stop], low[start:stop], many[start:stop], members, distance, before)
                start = stop
        todo = todo[distance[todo] >= side]
    far = distance >= radius
    distance[far], before[far] = np.inf, -1
    return distance, before


def _meet(x, y, rank, todo, low, many, members, distance, before) -> None:
    """Keeps the best of ``many`` members from ``low`` on for each point of ``todo``."""
    total = int(many.sum())
    if not total:
        return
    a = np.repeat(todo, many)
    b = members[np.repeat(low - np.cumsum(many) + many, many) + np.arange(total)]
    smaller = rank[b] < rank[a]
    a, b = a[smaller], b[smaller]
    if not len(a):
        return
    d = np.sqrt((x[a] - x[b]) * (x[a] - x[b]) + (y[a] - y[b]) * (y[a] - y[b]))
    starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    least = np.minimum.reduceat(d, starts)
    tied = d == np.repeat(least, np.diff(np.r_[starts, len(a)]))
    ranks = np.minimum.reduceat(np.where(tied, rank[b], np.iinfo(np.int64).max), starts)
    p = a[starts]
    at = np.empty(len(rank), np.int64)
    at[rank] = np.arange(len(rank))
    old = np.where(before[p] >= 0, rank[before[p]], np.iinfo(np.int64).max)
    better = (least < distance[p]) | ((least == distance[p]) & (ranks < old))
    distance[p[better]], before[p[better]] = least[better], at[ranks[better]]
