"""Pairs of points nearer than a width, by sorted bins, for many structures at once.

What comes in is grouped: a group is a structure, a block of one, or a group of
its points. Groups are numbered from 0 and a point meets points of its group
only, so one call serves as many groups as fit in memory. Candidates are made
and tested in chunks of a bounded number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from .geometry import BAD_SHIFT, INT32, moved

#: Points that are only sources; only targets, images made; both, images not yet
#: made; only targets, images not yet made.
SOURCE, TARGET, BOTH, RAW = 0, 1, 2, 3
#: Candidates tested, and images made, at a time; bins of a group along an axis.
MOST_CANDIDATES, MOST_MADE, MOST_BINS = 1 << 19, 1 << 20, 4096


@dataclass
class Points:
    group: np.ndarray  # ascending
    ids: np.ndarray
    raw: np.ndarray  # as given, in their own precision
    place: np.ndarray  # wrapped, or of the image; double
    shift: np.ndarray  # of a source: its wrap; of a target: its image's number less its wrap

    def take(self, at) -> Points:
        return Points(self.group[at], self.ids[at], self.raw[at], self.place[at], self.shift[at])


def images(points: Points, cells: np.ndarray, ranges: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, Points]]:
    """Images of points (whose shift is their wrap) that lie in a box; all given
    for each point. Chunks of (row of the point, images)."""
    sides = 2 * ranges + 1
    upto = np.cumsum(sides.prod(axis=1))
    for begin in range(0, int(upto[-1]) if len(upto) else 0, MOST_MADE):
        at = np.arange(begin, min(begin + MOST_MADE, int(upto[-1])))
        row = np.searchsorted(upto, at, side="right")
        rest = at - (upto - sides.prod(axis=1))[row]
        number = np.empty((len(at), 3), np.int64)
        for a in (2, 1, 0):
            rest, number[:, a] = np.divmod(rest, sides[row, a])
        number -= ranges[row]
        place = moved(points.place[row], number, cells[row])
        inside = ((place >= low[row]) & (place <= high[row])).all(axis=1)
        row, number = row[inside], number[inside]
        yield row, Points(points.group[row], points.ids[row], points.raw[row], place[inside], number - points.shift[row])


def _ranges_by_bin(sources: Points, targets: Points, width: np.ndarray) -> tuple[Points, np.ndarray, np.ndarray]:
    """Targets in order of their bins, and for each of nine rows of bins about
    each source (9, sources) the run of targets that lie there."""
    n = len(width)
    low, high = np.full((n, 3), np.inf), np.full((n, 3), -np.inf)
    heads = np.flatnonzero(np.r_[True, sources.group[1:] != sources.group[:-1]])
    low[sources.group[heads]] = np.minimum.reduceat(sources.place, heads)
    high[sources.group[heads]] = np.maximum.reduceat(sources.place, heads)
    w = width[:, None]
    inside = ((targets.place >= (low - w)[targets.group]) & (targets.place <= (high + w)[targets.group])).all(axis=1)
    targets = targets.take(inside)
    with np.errstate(invalid="ignore"):
        extent = np.where(high >= low, high - low, 0)
    size = np.maximum(w, extent / (MOST_BINS - 2))
    bins = np.floor(extent / size).astype(np.int64) + 3  # and one on either side
    base = np.cumsum(bins.prod(axis=1)) - bins.prod(axis=1)

    def keys(p: Points) -> np.ndarray:
        b = np.floor((p.place - low[p.group]) / size[p.group]).astype(np.int64) + 1
        b = np.clip(b, 0, bins[p.group] - 1)
        return base[p.group] + (b[:, 0] * bins[p.group, 1] + b[:, 1]) * bins[p.group, 2] + b[:, 2]

    key = keys(targets)
    order = np.argsort(key, kind="stable")
    targets, key = targets.take(order), key[order]
    own = keys(sources)
    plane, row = bins[sources.group, 1] * bins[sources.group, 2], bins[sources.group, 2]
    first = np.stack([own + dx * plane + dy * row - 1 for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    start = np.searchsorted(key, first.ravel())
    stop = np.searchsorted(key, first.ravel() + 2, side="right")
    return targets, start.reshape(9, -1), stop.reshape(9, -1)


def _all(sources: Points, targets: Points) -> tuple[Points, np.ndarray, np.ndarray]:
    targets = targets.take(np.argsort(targets.group, kind="stable"))
    start, stop = (np.searchsorted(targets.group, sources.group, side=s) for s in ("left", "right"))
    return targets, start[None], stop[None]


@dataclass
class Search:
    cutoff: float
    half_list: bool
    include_self: bool
    by_bins: bool

    def pairs(self, sources: Points, targets: Points, cells: np.ndarray, width: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Chunks of group, i, j, shift and displacement. cells and width are by group."""
        if not len(sources.ids) or not len(targets.ids):
            return
        targets, start, stop = (_ranges_by_bin if self.by_bins else lambda s, t, _: _all(s, t))(sources, targets, width)
        counts = (stop - start).T.ravel()  # by source
        start = start.T.ravel()
        rows = start.size // len(sources.ids)
        filled = np.flatnonzero(counts)
        counts, start = counts[filled], start[filled]
        of = filled // rows
        upto = np.cumsum(counts)
        near = width.max() ** 2
        kind = sources.raw.dtype.type
        limit, cells = kind(self.cutoff * self.cutoff), cells.astype(kind)
        begin = 0
        while begin < len(counts):
            done = upto[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(upto, done + MOST_CANDIDATES, side="right")))
            own = counts[begin:end]
            s = np.repeat(of[begin:end], own)
            t = np.repeat(start[begin:end] - (upto[begin:end] - own - done), own) + np.arange(int(own.sum()))
            begin = end
            if self.by_bins:
                away = targets.place[t]
                away -= sources.place[s]
                close = np.einsum("nx,nx->n", away, away) <= near
                s, t = s[close], t[close]
            i, j = sources.ids[s], targets.ids[t]
            shift = targets.shift[t] + sources.shift[s]
            d = targets.raw[t] - sources.raw[s]
            group = sources.group[s]
            for a in range(3):
                d += shift[:, a : a + 1].astype(kind) * cells[group, a]
            # in the order (x + y) + z
            square = (d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1]) + d[:, 2] * d[:, 2]
            selves = (i == j) & ~shift.any(axis=1)
            keep = np.where(selves, self.include_self, square < limit)
            if self.half_list:
                x, y, z = shift.T
                keep &= (i < j) | ((i == j) & ((x < 0) | (x == 0) & ((y < 0) | (y == 0) & (z <= 0))))
            shift = shift[keep]
            if ((shift >= INT32) | (shift < -INT32)).any():
                raise RuntimeError(BAD_SHIFT)
            yield group[keep], i[keep], j[keep], shift.astype(np.int32), d[keep]

    def search(self, points: Points, role: np.ndarray, cells: np.ndarray, ranges: np.ndarray, width: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Pairs of points of several roles; cells, ranges and width are by group."""
        sources = points.take((role == SOURCE) | (role == BOTH))
        if not len(sources.ids):
            return
        made = points.take(role == TARGET)
        yield from self.pairs(sources, made, cells, width)
        raw = points.take((role == BOTH) | (role == RAW))
        if not len(raw.ids):
            return
        if self.by_bins:
            n = len(width)
            low, high = np.full((n, 3), np.inf), np.full((n, 3), -np.inf)
            np.minimum.at(low, sources.group, sources.place)
            np.maximum.at(high, sources.group, sources.place)
            low, high = (low - width[:, None])[raw.group], (high + width[:, None])[raw.group]
        else:
            low, high = np.full((len(raw.ids), 3), -np.inf), np.full((len(raw.ids), 3), np.inf)
        for _, some in images(raw, cells[raw.group], ranges[raw.group], low, high):
            yield from self.pairs(sources, some, cells, width)
