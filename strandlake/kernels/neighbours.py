"""Pairs of near points, in one frame or in many at once."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np

Box = tuple[float, float, float] | None
_MOST_CELLS = 1000  # along an axis of a frame without a box: far outliers widen the cells instead of numbering empty space


def _cells(points: list[np.ndarray], frames: list[np.ndarray], n: int, reach: float, box: Box) -> tuple[list[np.ndarray], np.ndarray]:
    """Cell (x, y, z) of each point, from 1 on without a box and from 0 in one; cells of each frame along each axis, with an empty rim without a box."""
    if box:
        sides = np.array(box)
        count = np.maximum(1, np.floor(sides / reach)).astype(np.int64)
        return [np.minimum((np.mod(p, sides) / sides * count).astype(np.int64), count - 1) for p in points], np.broadcast_to(count, (n, 3))
    low, high = np.full((n, 3), np.inf), np.full((n, 3), -np.inf)
    for p, f in zip(points, frames):
        if len(p):
            first = np.flatnonzero(np.append(True, f[1:] != f[:-1]))
            low[f[first]] = np.minimum(low[f[first]], np.minimum.reduceat(p, first))
            high[f[first]] = np.maximum(high[f[first]], np.maximum.reduceat(p, first))
    low, high = np.where(np.isfinite(low), low, 0.0), np.where(np.isfinite(high), high, 0.0)
    edge = np.maximum(reach, (high - low).max(axis=1) / _MOST_CELLS)[:, None]
    count = ((high - low) / edge).astype(np.int64) + 3
    return [((p - low[f]) / edge[f]).astype(np.int64) + 1 for p, f in zip(points, frames)], count


def _offsets(count: np.ndarray, box: Box, once: bool) -> Iterator[tuple[int, int, int, int]]:
    """(x, y, first z, last z) of the neighbouring cells to look into; with ``once`` those ahead, (0, 0, 0, .) being the own cell."""
    if not box:
        for x, y in product((-1, 0, 1), repeat=2):
            if not once or (x, y) > (0, 0):
                yield x, y, -1, 1
            elif (x, y) == (0, 0):
                yield 0, 0, 0, 1
        return
    around = [range(-1, 2) if c > 2 else range(c) for c in count[0].tolist()]
    for x, y, z in product(*around):
        if not once or (x, y, z) >= (0, 0, 0):
            yield x, y, z, z


def cell_candidates(
    a: np.ndarray, b: np.ndarray, frame_a: np.ndarray, frame_b: np.ndarray, reach: float, box: Box = None, once: bool = False, step: int = 2_000_000
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of the points of the same frame in the same or neighbouring cells of an edge of at least ``reach``, some ``step`` at a time: as many as points times
    the points around one. ``once``: ``b`` is ``a``, and each pair comes once, in either order."""
    n = int(max(frame_a.max(initial=-1), frame_b.max(initial=-1))) + 1
    (cell_a, cell_b), count = _cells([a, b], [frame_a, frame_b], n, reach, box)
    base = np.append(0, np.cumsum(count.prod(axis=1)))
    number = lambda c, f: base[f] + (c[:, 0] * count[f, 1] + c[:, 1]) * count[f, 2] + c[:, 2]
    key_b = number(cell_b, frame_b)
    order = np.argsort(key_b, kind="stable")
    key_b = key_b[order]
    rank = np.empty(len(b), np.int64)
    rank[order] = np.arange(len(b))
    wraps_short = bool(box) and count[0].min(initial=3) < 3
    for x, y, z0, z1 in _offsets(count, box, once and not wraps_short):
        ends = []
        for z, side in ((z0, "left"), (z1, "right")):
            c = cell_a + (x, y, z)
            ends.append(np.searchsorted(key_b, number(np.mod(c, count[0]) if box else c, frame_a), side=side))
        lo, hi = ends
        if once and not wraps_short and (x, y, z0) == (0, 0, 0):
            lo = rank + 1  # the rest of the own cell
        size = np.maximum(hi - lo, 0)
        total = np.append(0, np.cumsum(size))
        start = 0
        while start < len(a):
            stop = max(start + 1, int(np.searchsorted(total, total[start] + step, side="right")) - 1)
            k = size[start:stop]
            i = np.repeat(np.arange(start, stop), k)
            j = order[np.arange(len(i)) + np.repeat(lo[start:stop] - total[start:stop] + total[start], k)]
            if once and wraps_short:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j
            start = stop


def all_candidates(n_a: np.ndarray, n_b: np.ndarray, once: bool = False, step: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j) of frames of few points, some ``step`` at a time; ``once``: i < j."""
    at_b = np.append(0, np.cumsum(n_b))
    frame_a = np.repeat(np.arange(len(n_a)), n_a)
    partners, first = n_b[frame_a], at_b[frame_a]
    if once:
        first = np.arange(len(frame_a)) + 1
        partners = at_b[frame_a + 1] - first
    ends = np.append(0, np.cumsum(partners))
    start = 0
    while start < len(frame_a):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + step, side="right")) - 1)
        k = partners[start:stop]
        i = np.repeat(np.arange(start, stop), k)
        if len(i):
            yield i, np.arange(len(i)) - np.repeat(ends[start:stop] - ends[start], k) + np.repeat(first[start:stop], k)
        start = stop


def pairs_in_frames(
    a: np.ndarray, b: np.ndarray | None, frame_a: np.ndarray, frame_b: np.ndarray | None, cutoff: float, strict: bool = False, box: Box = None, small: int = 2500
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance) of the points of ``a`` (N, 3) and ``b`` (M, 3) in the same frame at most ``cutoff`` apart, less than that if ``strict``; with a periodic ``box`` the
    nearest image counts. Frames are numbered from 0 in ascending order. Without ``b``: pairs of different points of ``a``, each once.

    Frames of at most ``small`` pairs are searched whole, larger ones by cells of the cutoff's size."""
    once = b is None
    b, frame_b = (a, frame_a) if once else (b, frame_b)
    n = int(max(frame_a.max(initial=-1), frame_b.max(initial=-1))) + 1
    n_a, n_b = np.bincount(frame_a, minlength=n), np.bincount(frame_b, minlength=n)
    few = n_a * n_b <= small
    out = []
    for which, by_cells in ((few, False), (~few, True)):
        rows_a, rows_b = np.flatnonzero(which[frame_a]), np.flatnonzero(which[frame_b])
        if not len(rows_a) or not len(rows_b):
            continue
        p, q = a[rows_a], b[rows_b]
        if by_cells:
            renumber = np.cumsum(which) - 1
            found = cell_candidates(p, q, renumber[frame_a[rows_a]], renumber[frame_b[rows_b]], cutoff * (1 + 1e-9), box, once)
        else:
            found = all_candidates(n_a[which], n_b[which], once)
        for i, j in found:
            gap = p[i] - q[j]
            if box:
                gap -= np.round(gap / box) * box
            gap *= gap
            d = np.sqrt(gap[:, 0] + gap[:, 1] + gap[:, 2])
            near = np.flatnonzero(d < cutoff if strict else d <= cutoff)
            out.append((rows_a[i[near]], rows_b[j[near]], d[near]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(c) for c in zip(*out))
