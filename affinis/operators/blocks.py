"""Numpy helpers for blocks of vectors, run inside Spark tasks."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

# Tasks get these functions by value and need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Scores are compared at six decimals, so bounds leave room for rounding.
SLACK = 1e-5
# Cell of vectors without a direction or of another length; never skipped.
IRREGULAR = -1


def unit_rows(embs, width: int):
    """Positions and unit vectors of the rows that have a direction and ``width``."""
    lens = np.array([len(e) for e in embs], dtype="int64")
    fit = np.flatnonzero((lens == width) & (width > 0))
    if not len(fit):
        return fit, np.zeros((0, width))
    m = np.stack([np.asarray(embs[i], dtype="float64") for i in fit])
    norms = np.linalg.norm(m, axis=1)
    ok = (norms > 0) & np.isfinite(norms)
    return fit[ok], m[ok] / norms[ok, None]


def nearest_cell(embs, pivots):
    """Nearest pivot of each vector and the angle to it."""
    cell = np.full(len(embs), IRREGULAR, dtype="int32")
    angle = np.zeros(len(embs))
    at, m = unit_rows(embs, pivots.shape[1])
    step = rows_at_once(len(pivots))
    for s in range(0, len(at), step):
        cos = m[s: s + step] @ pivots.T
        cell[at[s: s + step]] = np.argmax(cos, axis=1)
        angle[at[s: s + step]] = np.arccos(np.clip(cos.max(axis=1), -1, 1))
    return cell, angle


def rows_at_once(width: int) -> int:
    """Rows of a matrix of this width that are worked on at once: about two million numbers."""
    return max(1, 2_000_000 // max(1, width))


def visits(embs, need, pivots, cells):
    """Queries x cells: True where the cell may hold one of the needed rows."""
    keep = np.ones((len(embs), len(cells)), dtype=bool)
    at, m = unit_rows(embs, pivots.shape[1])
    if not len(at) or not cells:
        return keep
    number, size, radius = (np.array(x) for x in zip(*cells))
    theta = np.arccos(np.clip(m @ pivots[number].T, -1, 1))
    low = np.cos(np.minimum(np.pi, theta + radius))
    high = np.cos(np.maximum(0.0, theta - radius))
    order = np.argsort(-low, axis=1)
    reached = np.cumsum(size[order], axis=1) >= need[at][:, None]
    first = np.argmax(reached, axis=1)
    sure = np.take_along_axis(low, order[np.arange(len(at)), first][:, None], axis=1)
    sure = np.where(reached.any(axis=1)[:, None], sure, -2.0)
    keep[at] = high + SLACK >= sure
    return keep


def by_length(embs):
    """Unit matrices of the vectors of each length; no direction gives NaN."""
    lens = np.array([len(e) for e in embs], dtype="int64")
    out = []
    for width in np.unique(lens):
        rows = np.flatnonzero(lens == width)
        m = np.stack([np.asarray(embs[i], dtype="float64") for i in rows])
        norms = np.sqrt(np.einsum("ij,ij->i", m, m))
        with np.errstate(divide="ignore", invalid="ignore"):
            unit = m / norms[:, None]
        unit[~(norms > 0)] = np.nan
        out.append((int(width), rows, unit))
    return out


def unit_matrices(numbers: np.ndarray, ends: np.ndarray) -> list:
    """``by_length`` of vectors that lie one after the other; vector i ends before ``ends[i + 1]``."""
    lens, out = np.diff(ends), []
    for width in np.unique(lens):
        rows = np.flatnonzero(lens == width)
        if len(rows) == len(lens):
            m = numbers.reshape(len(lens), width).astype(np.float64, copy=False)
        else:
            m = numbers[ends[:-1][rows][:, None] + np.arange(width)].astype(np.float64, copy=False)
        norms = np.sqrt(np.einsum("ij,ij->i", m, m))
        with np.errstate(divide="ignore", invalid="ignore"):
            unit = m / norms[:, None]
        unit[~(norms > 0)] = np.nan
        out.append((int(width), rows, unit))
    return out


# A best row as one number that sorts by query, then score downward, then place: 13, 22 and 29 bits.
MAX_QUERIES, MAX_ITEMS = 1 << 13, 1 << 29
_TOP = 1_000_000


class Best:
    """The ``k`` best items of each query of a block, from blocks of cosines whose items come in order of place.

    New rows wait until there are as many as are kept, then one sort decides. A query with ``k`` rows takes only
    scores above its last: an equal one of a later place ranks behind it.
    """

    def __init__(self, n_queries: int, k: int):
        if n_queries > MAX_QUERIES:
            raise ValueError(f"more than {MAX_QUERIES} queries in one block")
        self.n, self.k = n_queries, k
        self.kept, self.new, self.waiting = np.empty(0, np.uint64), [], 0
        # In millionths; everything but a masked item is above.
        self.least = np.full(n_queries, -5 * _TOP, np.int64)

    def add(self, rough: np.ndarray, first: int | np.ndarray, exact, slack: float, at_once: int) -> None:
        """Cosines of all queries with the items at places from ``first``, or at these ascending places; -inf is no item.

        The ``rough`` ones are off by less than ``slack`` and only tell which can matter; ``exact`` gives the true ones of
        some queries and columns, ``at_once`` of them together.
        """
        places = first if isinstance(first, np.ndarray) else first + np.arange(rough.shape[1])
        if len(places) and places[-1] >= MAX_ITEMS:
            raise ValueError(f"more than {MAX_ITEMS} items")
        bound = ((self.least - 1) / _TOP - slack).astype(rough.dtype)
        found = np.flatnonzero(rough > bound[:, None])
        for s in range(0, len(found), at_once):
            row, column = np.divmod(found[s: s + at_once], rough.shape[1])
            micro = np.rint(exact(row, column) * _TOP).astype(np.int64)
            good = micro > self.least[row]
            row, column, micro = row[good], column[good], micro[good]
            self.new.append(((row << 51) | ((_TOP - micro) << 29) | places[column]).astype(np.uint64))
            self.waiting += len(row)
        if self.waiting >= self.n * self.k:
            self._decide()

    def _decide(self) -> None:
        keys = np.concatenate([self.kept, *self.new])
        self.new, self.waiting = [], 0
        keys.sort()
        starts = np.searchsorted(keys, np.arange(self.n + 1, dtype=np.uint64) << np.uint64(51))
        count = np.minimum(np.diff(starts), self.k)
        full = count == self.k
        last = keys[starts[:-1][full] + self.k - 1]
        self.least[full] = _TOP - ((last >> np.uint64(29)) & np.uint64((1 << 22) - 1)).astype(np.int64)
        inside = np.zeros(len(keys) + 1, np.int8)
        np.add.at(inside, starts[:-1], 1)
        np.add.at(inside, starts[:-1] + count, -1)
        self.kept = keys[np.cumsum(inside[:-1], dtype=np.int8) > 0]

    def rows(self, at_once: int):
        """Query, place, millionths and rank from 1 of the best rows, in parts."""
        self._decide()
        starts = np.searchsorted(self.kept, np.arange(self.n, dtype=np.uint64) << np.uint64(51))
        for s in range(0, len(self.kept), at_once):
            keys = self.kept[s: s + at_once].astype(np.uint64)
            query = (keys >> np.uint64(51)).astype(np.int64)
            micro = _TOP - ((keys >> np.uint64(29)) & np.uint64((1 << 22) - 1)).astype(np.int64)
            place = (keys & np.uint64(MAX_ITEMS - 1)).astype(np.int64)
            yield query, place, micro, np.arange(s, s + len(keys)) - starts[query] + 1
