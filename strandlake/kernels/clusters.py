"""Nearest clusters by the mean distance of their frames; lower bounds leave few pairs of clusters whose frames are met.

A distance is the sum over feature sets of weight times length over the set's largest length (Euclidean or Manhattan). Two bounds of the mean over the frames of two clusters:
the length between their centres, and of each Euclidean set or Manhattan coordinate m2^1.5 / m4^0.5 (Hoelder) with m2, m4 the mean second and fourth powers of the lengths, which follow from
moments of each cluster."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

from strandlake.kernels import linear

#: Clusters of a block of bounds, frame pairs measured at once, those of a cluster that goes by blocks, and the most coordinates of a set with second moments.
ROWS, COLUMNS, PAIRS, MANY, WIDE = 128, 1024, 1 << 14, 1024, 16


class Set(NamedTuple):
    """Coordinates of a feature set, its weight, its largest length and its kind."""

    at: slice
    weight: float
    peak: float
    manhattan: bool

    @property
    def scale(self) -> float:
        return self.weight / self.peak if self.peak > 0 else self.weight


class Side(NamedTuple):
    """Frames in order of clusters, where each cluster begins, and their sizes."""

    x: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    def mean(self, of: np.ndarray) -> np.ndarray:
        if len(self.sizes) == len(of):
            return of
        return np.add.reduceat(of, self.starts, axis=0) / self.sizes.reshape(-1, *[1] * (of.ndim - 1))


def _moments(side: Side, s: Set, centre: np.ndarray) -> list[np.ndarray]:
    x = (side.x[:, s.at] - centre[s.at]) * s.scale
    if s.manhattan:
        return [side.mean(x**k) for k in (1, 2, 3, 4)]
    q = (x * x).sum(1)
    square = x[:, :, None] * x[:, None] if x.shape[1] <= WIDE else np.zeros((len(x), 0))
    return [side.mean(v) for v in (x, q, q * q, q[:, None] * x, square.reshape(len(x), -1))]


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b)


def lower_bounds(one: list, two: list, sets: list[Set], r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of the mean distances of the clusters ``r`` to ``c``, by moments. What rounding may add to a power is taken off before."""
    total = np.zeros(len(r))
    for a, b, s in zip(one, two, sets):
        a, b = [v[r] for v in a], [v[c] for v in b]
        off = 1e-12 * s.weight**2
        far = a[0] - b[0]
        if s.manhattan:
            between = np.abs(far)
            second = a[1] + b[1] - 2 * a[0] * b[0]
            fourth = a[3] + b[3] + 6 * a[1] * b[1] - 4 * (a[2] * b[0] + a[0] * b[2])
        else:
            between = np.sqrt(_dot(far, far))
            if not a[4].shape[1]:
                total += between
                continue
            second = a[1] + b[1] - 2 * _dot(a[0], b[0])
            fourth = a[2] + b[2] + 2 * a[1] * b[1] + 4 * (_dot(a[4], b[4]) - _dot(a[3], b[0]) - _dot(a[0], b[3]))
        second, fourth = np.maximum(second - off, 0), np.maximum(fourth, second * second) + off * s.weight**2
        bound = np.maximum(between, second * np.sqrt(second / fourth)) if off else between
        total += bound.sum(1) if s.manhattan else bound
    return total


def mean_distances(one: Side, two: Side, sets: list[Set], r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Mean distances of the clusters ``r`` to ``c``, from all pairs of their frames: a cluster of ``one`` that meets many frames by blocks, the others frame by frame."""
    count = one.sizes[r] * two.sizes[c]
    out, flat = np.empty(len(r)), np.ones(len(r), bool)
    order = np.argsort(r, kind="stable")
    begins = np.flatnonzero(np.diff(r[order], prepend=-1) != 0)
    met = np.add.reduceat(count[order], begins) if len(begins) else begins
    for k in np.flatnonzero(met >= MANY):
        part = order[begins[k] : begins[k + 1] if k + 1 < len(begins) else None]
        flat[part] = False
        row, n = r[part[0]], two.sizes[c[part]]
        first = np.cumsum(n) - n
        y = two.x[np.arange(n.sum()) + np.repeat(two.starts[c[part]] - first, n)]
        x = one.x[one.starts[row] : one.starts[row] + one.sizes[row]]
        out[part] = np.add.reduceat(sum(d.sum(0) for _, d in distance_blocks(x, y, sets)), first) / count[part]
    flat = np.flatnonzero(flat)
    ends = np.cumsum(count[flat])
    for part in np.split(flat, np.flatnonzero(np.diff((ends - 1) // PAIRS)) + 1) if len(flat) else ():
        n = count[part]
        first = np.cumsum(n) - n
        i, j = np.divmod(np.arange(n.sum()) - np.repeat(first, n), np.repeat(two.sizes[c[part]], n))
        i += np.repeat(one.starts[r[part]], n)
        j += np.repeat(two.starts[c[part]], n)
        diff = one.x[i]
        diff -= two.x[j]
        d = 0.0
        for s in sets:
            v = diff[:, s.at]
            d = d + s.weight * ((np.abs(v) @ np.ones(v.shape[1]) if s.manhattan else np.sqrt(_dot(v, v))) / (s.peak if s.peak > 0 else 1.0))
        out[part] = d if len(d) == len(part) else np.add.reduceat(d, first) / n
    return out


def distance_blocks(x: np.ndarray, y: np.ndarray, sets: list[Set]) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, distances to all frames ``y``) of some of the frames ``x`` at a time."""
    step = max(1, 32768 // max(1, len(y)))
    for parts in zip(*(linear.distance_blocks(x[:, s.at], y[:, s.at], s.manhattan, step) for s in sets)):
        yield parts[0][0], sum(s.weight * (p / (s.peak if s.peak > 0 else 1.0)) for (_, p), s in zip(parts, sets))


def largest(x: np.ndarray, y: np.ndarray, manhattan: bool) -> float:
    """The largest length between any of the frames ``x`` and ``y`` together, those of ``x`` and ``y`` met: frames too near to the centre to be part of it are left out."""
    both = np.concatenate([x, y])
    if not len(both):
        return 0.0
    length = lambda v: np.abs(v).sum(1) if manhattan else np.sqrt(_dot(v, v))
    far = length(both - both.mean(0))
    found, at = 0.0, int(far.argmax())
    for _ in range(3):
        reach = length(both - both[at])
        at, found = int(reach.argmax()), max(found, float(reach.max()))
    least = (found - far.max()) * (1 - 1e-9)
    a, b = x[far[: len(x)] >= least], y[far[len(x) :] >= least]
    return max([found, *(float(d.max(initial=0.0)) for _, d in linear.distance_blocks(a, b, manhattan))])


class _Best:
    """The nearest so far of each cluster of a side, the first of equals."""

    def __init__(self, n: int, cutoff: float):
        self.value, self.other = np.full(n, cutoff), np.full(n, -1)

    def update(self, of: np.ndarray, other: np.ndarray, value: np.ndarray) -> None:
        order = np.lexsort((other, value, of))
        of, first = np.unique(of[order], return_index=True)
        other, value = other[order][first], value[order][first]
        old, known = self.value[of], self.other[of]
        less = (value < old) | ((value == old) & ((known < 0) | (other < known)))
        self.value[of[less]], self.other[of[less]] = value[less], other[less]


def nearest(one: Side, two: Side, sets: list[Set], cutoff: float, same: bool, columns: bool) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(clusters, their nearest of the other side, mean distance) of those of ``one`` and, if asked for, of ``two``, that have any within ``cutoff``.
    ``same``: both sides are the same clusters, which do not meet themselves."""
    n, m = len(one.sizes), len(two.sizes)
    best = _Best(n, cutoff), _Best(m, cutoff)
    if not n or not m:
        return []
    centre = np.concatenate([one.x, two.x]).mean(0)
    a, b = ([_moments(side, s, centre) for s in sets] for side in (one, two))
    margin = sum(s.weight for s in sets) * (eps := 4e-6 + 2.5e-7 * one.x.shape[1])  # for the bounds' single precision
    single = one.sizes == 1, two.sizes == 1
    flat = []
    for u, v, s in zip(a, b, sets):
        u, v = u[0].astype(np.float32), v[0].astype(np.float32)
        if s.manhattan:
            flat.append((u, np.ascontiguousarray(v.T)))
        else:
            p, q = ((w * w).sum(1, keepdims=True) * np.float32(1 - eps) for w in (u, v))
            flat.append((np.hstack([-2 * u, p, np.ones_like(p)]), np.ascontiguousarray(np.hstack([v, np.ones_like(q), q]).T)))

    def bounds(i: int, j: int) -> np.ndarray:
        total = None
        for (u, v), s in zip(flat, sets):
            u, v = u[i : i + ROWS], v[:, j : j + COLUMNS]
            if s.manhattan:
                d = np.zeros((len(u), v.shape[1]), np.float32)
                diff = np.empty_like(d)
                for k in range(len(v)):
                    np.subtract(u[:, k, None], v[k], out=diff)
                    d += np.abs(diff, out=diff)
            else:
                d = u @ v
                np.sqrt(np.maximum(d, 0, out=d), out=d)
            total = d if total is None else np.add(total, d, out=total)
        return total

    def measure(r: np.ndarray, c: np.ndarray) -> None:
        if len(r):
            d = mean_distances(one, two, sets, r, c)
            best[0].update(r, c, d)
            if columns:
                best[1].update(c, r, d)

    def limits(r: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (np.maximum(best[0].value[r], best[1].value[c]) if columns else best[0].value[r]) + margin

    for i in range(0, n, ROWS):
        for j in range(0, m, COLUMNS):
            low = bounds(i, j)
            rows, cols = np.arange(i, i + len(low)), np.arange(j, j + low.shape[1])
            if same:
                own = np.arange(max(i, j), min(i + len(low), j + low.shape[1]))
                low[own - i, own - j] = np.inf
            at = low.argmin(1)
            some = low[np.arange(len(rows)), at] <= best[0].value[rows] + margin
            r, c = rows[some], cols[at[some]]
            if columns:
                some = np.flatnonzero(low.min(0) <= best[1].value[cols] + margin)
                r, c = np.concatenate([r, rows[low[:, some].argmin(0)]]), np.concatenate([c, cols[some]])
            measure(r, c)
            open_ = low <= (best[0].value[rows] + margin).astype(np.float32)[:, None]
            if columns:
                open_ |= low <= (best[1].value[cols] + margin).astype(np.float32)
            at = np.flatnonzero(open_)
            low = low.ravel()[at].astype(float)
            r, c = at // len(cols) + i, at % len(cols) + j
            loose = np.flatnonzero(~(single[0][r] & single[1][c]))
            if len(loose):
                for part in np.split(loose, np.arange(PAIRS, len(loose), PAIRS)):
                    low[part] = lower_bounds(a, b, sets, r[part], c[part])
                least = [np.lexsort((low, v)) for v in (r, c)[: 1 + columns]]
                least = np.unique(np.concatenate([o[np.diff(v[o], prepend=-1) > 0] for o, v in zip(least, (r, c))]))
                least = least[low[least] <= limits(r[least], c[least])]
                measure(r[least], c[least])
                low[least] = np.inf
            keep = low <= limits(r, c)
            measure(r[keep], c[keep])
    out = []
    for k in (0, 1)[: 1 + columns]:
        known = np.flatnonzero(best[k].other >= 0)
        out.append((known, best[k].other[known], best[k].value[known]))
    return out
