"""Small numpy kernels over stacks of frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def superpose(mobile: np.ndarray, target: np.ndarray, fit: np.ndarray | None = None) -> np.ndarray:
    """Frames (F, N, 3) rotated and moved onto ``target`` (N, 3) by least squares over the atoms ``fit`` (all by default)."""
    m = mobile if fit is None else mobile[:, fit]
    t = target if fit is None else target[fit]
    mc, tc = m.mean(1, keepdims=True), t.mean(0)
    u, _, vt = np.linalg.svd(np.einsum("fni,nj->fij", m - mc, t - tc))
    d = np.sign(np.linalg.det(u @ vt))
    u[:, :, -1] *= d[:, None]
    return (mobile - mc) @ (u @ vt) + tc


def superpose_each(mobile: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Frames (F, N, 3) rotated and moved each onto its own target (F, N, 3)."""
    mc, tc = mobile.mean(1, keepdims=True), targets.mean(1, keepdims=True)
    u, _, vt = np.linalg.svd((mobile - mc).swapaxes(1, 2) @ (targets - tc))
    u[:, :, -1] *= np.sign(np.linalg.det(u @ vt))[:, None]
    return (mobile - mc) @ (u @ vt) + tc


def distances(x: np.ndarray, manhattan: bool = False, step: int = 64, of: np.ndarray | None = None) -> np.ndarray:
    """Distances of the rows ``of`` (all by default) to all rows, made some rows at a time."""
    some = x if of is None else x[of]
    out = np.empty((len(some), len(x)))
    for i in range(0, len(some), step):
        diff = some[i : i + step, None] - x[None]
        out[i : i + step] = np.abs(diff).sum(2) if manhattan else np.sqrt((diff * diff).sum(2))
    return out


def distance_blocks(x: np.ndarray, y: np.ndarray, manhattan: bool = False, step: int = 32) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, distances to all rows of ``y``) of some rows of ``x`` at a time, a coordinate after the other."""
    columns = np.ascontiguousarray(y.T)
    for i in range(0, len(x), step):
        some = x[i : i + step]
        out = np.zeros((len(some), len(y)))
        for k, c in enumerate(columns):
            diff = some[:, k, None] - c
            out += np.abs(diff, out=diff) if manhattan else np.multiply(diff, diff, out=diff)
        yield i, out if manhattan else np.sqrt(out, out=out)


def rmsd(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Root mean square distance of frames (F, N, 3) to (N, 3) as they lie."""
    return np.sqrt(((a - b) ** 2).sum(-1).mean(-1))


def _laguerre(root: np.ndarray, p: np.ndarray, e: np.ndarray, c: np.ndarray, step: np.ndarray, t: np.ndarray, slope: np.ndarray) -> np.ndarray:
    """Laguerre's step for (l^2 - p)^2 + c l - e, whose roots are real; leaves the slope at ``root``. step, t, slope: room to work in."""
    np.multiply(root, root, out=t)
    np.subtract(t, p, out=step)
    np.multiply(root, step, out=slope)
    slope *= 4
    slope += c
    step *= step
    step -= e
    v = c * root
    step += v
    t *= 3
    t -= p
    t *= step
    t *= -48
    np.multiply(slope, slope, out=v)
    v *= 9
    v += t
    np.sqrt(np.maximum(v, 0, out=v), out=v)
    v += slope
    step *= 4
    return np.divide(step, v, out=step)


def _settled(step: np.ndarray, root: np.ndarray, p: np.ndarray, slope: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Where what a step leaves, about its square times f'' / 2 f', is nothing."""
    return step * step * np.abs(3 * root * root - p) * 2e13 <= np.abs(slope) * half


def _invariants(a: np.ndarray, b: np.ndarray, rows: int, cols: int) -> Iterator[tuple]:
    """Of centred frames (3, F, N) and (3, G, N), for a block of pairs at a time: first row and column, the 3 x 3 correlations H (3, 3, rows, columns), half the frames' summed squares, and in
    planes p = |H|^2, four times the squared length of H's cofactors, -8 det(H), the largest the best overlap can be, and room for three more. All but the half is written over by the next block."""
    n = a.shape[2]
    own, other = ((x**2).sum((0, 2)) / 2 for x in (a, b))
    room, planes = np.empty(9 * rows * cols, a.dtype), np.empty((7, rows * cols), a.dtype)
    for j in range(0, b.shape[1], cols):
        y = np.ascontiguousarray(b[:, j : j + cols].transpose(0, 2, 1))
        for i in range(0, a.shape[1], rows):
            x = np.ascontiguousarray(a[:, i : i + rows])
            f, g = x.shape[1], y.shape[2]
            h = room[: 9 * f * g].reshape(3, 3 * f, g)
            for k in range(3):
                np.matmul(x.reshape(-1, n), y[k], out=h[k])
            h = h.reshape(3, 3, f, g)
            p, e, c, root, step, t, slope = (v[: f * g].reshape(f, g) for v in planes)
            half = own[i : i + f, None] + other[None, j : j + g]
            for v in (p, e, c):
                v.fill(0)
            for r in range(3):
                for k in range(3):
                    np.multiply(h[r, k], h[r, k], out=t)
                    p += t
                    np.multiply(h[r - 2, k - 2], h[r - 1, k - 1], out=t)
                    t -= np.multiply(h[r - 2, k - 1], h[r - 1, k - 2], out=step)
                    if r == 0:
                        c += np.multiply(h[0, k], t, out=step)
                    t *= t
                    e += t
            e *= 4
            c *= -8
            np.sqrt(np.multiply(e, 3, out=t), out=t)
            t += p
            np.sqrt(t, out=root)
            root *= 1 + (1e-9 if root.itemsize == 8 else 1e-6)
            np.minimum(root, half, out=root)
            yield i, j, h, half, p, e, c, root, step, t, slope


def fitted_rmsd_blocks(mobile: np.ndarray, targets: np.ndarray, rows: int = 32, cols: int = 512) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, first column, block) of the RMSD after optimal superposition of every frame of ``mobile`` (F, N, 3) onto every one of ``targets`` (G, N, 3), in blocks that a core's cache holds.

    The best overlap of two frames is the largest root, at most the root of p + 2 sqrt(3 e), of l^4 - 2 p l^2 - 8 det(H) l + p^2 - 4 e with H their 3 x 3 correlation, p = |H|^2 and e the squared length of
    its cofactors: its roots are the signed sums of H's singular values. Two steps of Laguerre's and one of Newton's settle most pairs of a block; the others go on by themselves, equal singular values to an SVD."""
    a, b = ((x - x.mean(1, keepdims=True)).transpose(2, 0, 1) for x in (mobile, targets))
    for i, j, h, half, p, e, c, root, step, t, slope in _invariants(a, b, rows, cols):
        with np.errstate(divide="ignore", invalid="ignore"):
            for _ in range(2):
                root -= _laguerre(root, p, e, c, step, t, slope)
            np.multiply(root, root, out=t)
            t -= p
            np.multiply(root, t, out=slope)
            slope *= 4
            slope += c
            t *= t
            t -= e
            t += np.multiply(c, root, out=step)
            root -= np.divide(t, slope, out=step)
            left = np.flatnonzero(~_settled(step, root, p, slope, half))
            if len(left):
                root.ravel()[left] = _settle(h.reshape(9, -1), left, *(v.ravel()[left] for v in (root, p, e, c, half)))
        half -= root
        half *= 2 / mobile.shape[1]
        yield i, j, np.sqrt(np.maximum(half, 0, out=half), out=half)


def least_rmsd_blocks(mobile: np.ndarray, targets: np.ndarray, rows: int = 32, cols: int = 1024) -> Iterator[tuple[int, int, np.ndarray]]:
    """As ``fitted_rmsd_blocks``, what the RMSD is at least, in single precision and a fraction of the time: Laguerre's step from above does not pass the
    largest root, so after one the overlap is still bounded. A ten-thousandth of the frames' squares is taken off for rounding."""
    a, b = ((x - x.mean(1, keepdims=True)).transpose(2, 0, 1) for x in (mobile, targets))
    scale = np.sqrt(max([(v**2).sum((0, 2)).max(initial=0.0) for v in (a, b)])) or 1.0
    a, b = ((v / scale).astype(np.float32) for v in (a, b))
    for i, j, _, half, p, e, c, root, step, t, slope in _invariants(a, b, rows, cols):
        with np.errstate(divide="ignore", invalid="ignore"):
            np.subtract(root, _laguerre(root, p, e, c, step, t, slope), out=step)
        if not np.isfinite(step).all():
            np.copyto(step, root, where=~np.isfinite(step))
        half *= 1 - 1e-4
        half -= step
        half *= 2 * scale**2 / mobile.shape[1]
        yield i, j, np.sqrt(np.maximum(half, 0, out=half), out=half)


def _settle(h: np.ndarray, which: np.ndarray, root: np.ndarray, p: np.ndarray, e: np.ndarray, c: np.ndarray, half: np.ndarray, steps: int = 12) -> np.ndarray:
    """The roots of the pairs ``which`` of a block, of correlations ``h``."""
    start = np.minimum(half, np.sqrt(p + np.sqrt(3 * e)) * (1 + 1e-9))
    root = np.where(np.isfinite(root), root, start)
    moving = np.arange(len(root))
    for _ in range(steps):
        z, q, m = root[moving], p[moving], half[moving]
        step, t, slope = np.empty((3, len(moving)))
        z -= _laguerre(z, q, e[moving], c[moving], step, t, slope)
        known = np.isfinite(z)
        root[moving[known]] = z[known]
        moving = moving[~(known & _settled(step, z, q, slope, m))]
        if not len(moving):
            return root
    m = h[:, which[moving]].T.reshape(-1, 3, 3)
    s = np.linalg.svd(m, compute_uv=False)
    s[:, -1] *= np.sign(np.linalg.det(m))
    root[moving] = s.sum(-1)
    return root


def fitted_rmsd(mobile: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """RMSD after optimal superposition of every frame of ``mobile`` (F, N, 3) onto every one of ``targets`` (G, N, 3)."""
    out = np.empty((len(mobile), len(targets)))
    for i, j, d in fitted_rmsd_blocks(mobile, targets):
        out[i : i + d.shape[0], j : j + d.shape[1]] = d
    return out


def plane_axes(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, directions within the best plane (F, 2, 3), its normal) of point sets (F, K, 3), from their 3 x 3 scatter."""
    centre = points.mean(1)
    d = points - centre[:, None]
    _, v = np.linalg.eigh(d.swapaxes(1, 2) @ d)
    return centre, v[:, :, 2:0:-1].swapaxes(1, 2), v[:, :, 0]


def _cosine(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosines of rows of u with unit rows of v; 1 where u has no length."""
    length = np.linalg.norm(u, axis=1)
    some = length >= 1e-6
    return np.where(some, (u * v).sum(1) / np.where(some, length, 1.0), 1.0)


def docking_angles(x: np.ndarray, platform: np.ndarray, alpha: np.ndarray, beta: np.ndarray, peptide: np.ndarray, least_cos: float = 0.174) -> np.ndarray:
    """(crossing, incident, polarity) of each frame.

    Crossing: the angle between the line from the alpha to the beta domain, laid into the platform's plane, and that plane's direction that the
    peptide follows. Incident: the angle between the plane's normal and the line from groove to receptor. Polarity: which
    way the first line runs along the peptide; 0 near a right angle."""
    groove, plane, normal = plane_axes(x[:, platform])
    run = x[:, peptide[-1]] - x[:, peptide[0]]
    along = (plane @ run[:, :, None])[:, :, 0]
    which = np.abs(along).argmax(1)
    rows = np.arange(len(x))
    axis = plane[rows, which] * np.where(along[rows, which] < 0, -1.0, 1.0)[:, None]
    first, second = x[:, alpha].mean(1), x[:, beta].mean(1)
    between = second - first
    flat = between - (between * normal).sum(1, keepdims=True) * normal
    turn = _cosine(flat, axis)
    rise = _cosine((first + second - groove - x[:, peptide].mean(1)) / 2, normal)
    crossing, incident = (np.degrees(np.arccos(np.minimum(np.abs(c), 1.0))) for c in (turn, rise))
    level = np.linalg.norm(flat, axis=1) >= 1e-6
    polarity = np.where(level & (np.abs(turn) >= least_cos), np.sign(turn), 0.0)
    return np.stack([crossing, incident, polarity], 1) * (np.linalg.norm(between, axis=1) >= 1e-6)[:, None]


def _unit(v: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(v, axis=-1, keepdims=True)
    return v / np.where(length > 1e-9, length, 1.0)


def long_axis(points: np.ndarray) -> np.ndarray:
    """Directions of the largest spread of point sets (F, K, 3)."""
    return plane_axes(points)[1][:, 0]


def reference_groove_angles(x: np.ndarray, ref: np.ndarray, helix_1: np.ndarray, helix_2: np.ndarray, backbone: np.ndarray, receptor: np.ndarray) -> np.ndarray:
    """(crossing, incident) of each frame against the groove of the reference frame (N, 3): along the mean of the two helices' axes, and across them to
    their centres. The receptor's direction runs from the backbone's centre to the receptor's centre in the frame itself. Both angles are acute."""
    one, two = (long_axis(ref[None, h])[0] for h in (helix_1, helix_2))
    along = _unit(one + two * (1.0 if one @ two >= 0 else -1.0))
    across = ref[helix_2].mean(0) - ref[helix_1].mean(0)
    normal = _unit(np.cross(along, across))
    aim = x[:, receptor].mean(1) - x[:, backbone].mean(1)
    flat = aim - (aim @ normal)[:, None] * normal
    length = np.linalg.norm(flat, axis=1)
    turn = np.where(length < 1e-8, 0.0, np.abs(flat @ along) / np.where(length < 1e-8, 1.0, length))
    rise = np.abs(_unit(aim) @ normal)
    return np.degrees(np.arccos(np.minimum(np.stack([turn, rise], 1), 1.0)))


def view_frame(x: np.ndarray, chains: list[np.ndarray]) -> np.ndarray:
    """Up, view direction, box centre (3 each) and half sizes (2) of each frame, of atoms in four chains or more.

    Roles by size and place: the peptide is the shortest chain, beta-2 microglobulin of the others the one nearest to 100 atoms, the heavy chain of the rest
    the one nearest to it; what is left is the receptor. Up runs to the receptor, the peptide lies across the view."""
    sizes = np.array([len(c) for c in chains])
    pep = int(sizes.argmin())
    b2m = min((i for i in range(len(chains)) if i != pep), key=lambda i: (abs(sizes[i] - 100), i))
    rest = [i for i in range(len(chains)) if i not in (pep, b2m)]
    centres = np.stack([x[:, c].mean(1) for c in chains], 1)
    heavy = np.linalg.norm(centres[:, rest] - centres[:, b2m, None], axis=2).argmin(1)
    weights = np.zeros((len(x), len(chains), 2))  # of each chain in the two sides
    for k, i in enumerate(rest):
        weights[:, i, 0], weights[:, i, 1] = sizes[i] * (heavy == k), sizes[i] * (heavy != k)
    weights[:, [pep, b2m], 0] = sizes[[pep, b2m]]
    sides = np.einsum("fcs,fcj->fsj", weights / weights.sum(1, keepdims=True), centres)
    up = _unit(sides[:, 1] - sides[:, 0])
    flat = long_axis(x[:, chains[pep]])
    flat = flat * np.where(np.einsum("fj,fj->f", flat, x[:, chains[pep][-1]] - x[:, chains[pep][0]]) < 0, -1.0, 1.0)[:, None]
    right = _unit(flat - (flat * up).sum(1, keepdims=True) * up)
    axes = np.stack([right, up, _unit(np.cross(right, up))], 1)
    every = x[:, np.concatenate(chains)]
    middle = every.mean(1)
    along = (every - middle[:, None]) @ axes.swapaxes(1, 2)
    low, high = along.min(1), along.max(1)
    centre = middle + np.einsum("fk,fkj->fj", (low + high) / 2, axes)
    return np.concatenate([up, axes[:, 2], centre, (high - low)[:, :2] / 2], 1)


def spectrum(values: np.ndarray) -> tuple[int, float]:
    """(modes that hold nine tenths of the variance, exp of the shares' entropy) of eigenvalues."""
    v = np.clip(np.sort(values)[::-1], 0, None)
    p = v / (v.sum() or 1.0)
    q = p[p > 0]
    return int(np.searchsorted(np.cumsum(p), 0.90) + 1), float(np.exp(-(q * np.log(q)).sum()))


def average_linkage(d: np.ndarray, cutoff: float, sizes: np.ndarray | None = None) -> np.ndarray:
    """Labels of average-linkage clusters cut at ``cutoff``, by nearest-neighbour chains; numbered by first member. ``sizes``: of clusters that are linked further."""
    n = len(d)
    d = np.array(d, float)
    np.fill_diagonal(d, np.inf)
    size, alive = np.ones(n) if sizes is None else sizes.astype(float), np.ones(n, bool)
    up = list(range(n))
    chain: list[int] = []
    while alive.sum() > 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        a = chain[-1]
        row = np.where(alive, d[a], np.inf)
        b = int(row.argmin())
        if len(chain) > 1 and row[chain[-2]] <= row[b]:
            b = chain[-2]
        if len(chain) > 1 and b == chain[-2]:
            chain = chain[:-2]
            i, j = min(a, b), max(a, b)
            if d[a, b] <= cutoff:
                up[j] = i
            new = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
            d[i], d[:, i] = new, new
            d[i, i] = np.inf
            size[i] = size[a] + size[b]
            alive[j] = False
        else:
            chain.append(b)

    def root(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    roots = [root(i) for i in range(n)]
    number = {r: k for k, r in enumerate(dict.fromkeys(roots))}
    return np.array([number[r] for r in roots])


def gaussian_sums(x: np.ndarray, y: np.ndarray, gx: np.ndarray, gy: np.ndarray, precision: tuple[float, float, float], step: int = 256) -> np.ndarray:
    """Sums of unscaled Gaussians around the points on the grid (gx, gy); ``precision``: xx, xy and yy of the inverse covariance."""
    xx, xy, yy = precision
    out = np.zeros((len(gx), len(gy)))
    for i in range(0, len(x), step):
        dx, dy = gx[None] - x[i : i + step, None], gy[None] - y[i : i + step, None]
        out += np.exp(-0.5 * (xx * (dx * dx)[:, :, None] + 2 * xy * dx[:, :, None] * dy[:, None] + yy * (dy * dy)[:, None])).sum(0)
    return out


def generalized_eigen(a: np.ndarray, b: np.ndarray, floor: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of a v = l b v for symmetric a and positive b, by whitening."""
    w, u = np.linalg.eigh(b)
    keep = w > floor
    white = u[:, keep] / np.sqrt(w[keep])
    values, vectors = np.linalg.eigh(white.T @ a @ white)
    return values, white @ vectors
