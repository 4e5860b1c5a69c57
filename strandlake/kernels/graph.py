"""Communities and centrality of one trajectory's contact network."""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np

from strandlake.kernels.neighbours import pairs_in_frames


def modularity(edges: list[tuple[int, int, float]], label: dict[int, int]) -> float:
    total = sum(w for _, _, w in edges)
    if total <= 0:
        return 0.0
    inside, degree = defaultdict(float), defaultdict(float)
    for i, j, w in edges:
        degree[label[i]] += w
        degree[label[j]] += w
        if label[i] == label[j]:
            inside[label[i]] += w
    return float(sum(inside[c] / total - (degree[c] / (2 * total)) ** 2 for c in degree))


def communities(nodes: list[int], edges: list[tuple[int, int, float]], seed: int = 42) -> dict[int, int]:
    """Louvain: nodes move to the neighbouring community of the largest gain until none does, then communities become nodes. Labels
    are numbered by size, then by smallest node."""
    rng = np.random.default_rng(seed)
    member = {n: n for n in nodes}
    level = list(edges)
    while True:
        graph: dict[int, dict[int, float]] = {m: defaultdict(float) for m in set(member.values())}
        loops: dict[int, float] = defaultdict(float)
        for i, j, w in level:
            if i == j:
                loops[i] += w
            else:
                graph[i][j] += w
                graph[j][i] += w
        degree = {n: sum(graph[n].values()) + 2 * loops[n] for n in graph}
        total = sum(degree.values()) / 2
        if total <= 0:
            break
        label, weight = {n: n for n in graph}, dict(degree)
        moved_any, moved = False, True
        order = sorted(graph)
        rng.shuffle(order)
        while moved:
            moved = False
            for n in order:
                near: dict[int, float] = defaultdict(float)
                for m, w in graph[n].items():
                    near[label[m]] += w
                own = label[n]
                weight[own] -= degree[n]
                gain = {c: w - weight[c] * degree[n] / (2 * total) for c, w in near.items()}
                gain.setdefault(own, -weight[own] * degree[n] / (2 * total))
                best = max(gain, key=lambda c: (gain[c], c == own, -c))
                if best != own and gain[best] <= gain[own] + 1e-12:
                    best = own
                weight[best] += degree[n]
                if best != own:
                    label[n], moved, moved_any = best, True, True
        if not moved_any:
            break
        member = {n: label[m] for n, m in member.items()}
        merged: dict[tuple[int, int], float] = defaultdict(float)
        for i, j, w in level:
            a, b = sorted((label[i], label[j]))
            merged[a, b] += w
        level = [(a, b, w) for (a, b), w in merged.items()]
    groups = defaultdict(list)
    for n, c in member.items():
        groups[c].append(n)
    ranked = sorted(groups.values(), key=lambda g: (-len(g), min(g)))
    return {n: k for k, g in enumerate(ranked) for n in g}


def betweenness(nodes: list[int], edges: list[tuple[int, int, float]]) -> dict[int, float]:
    """Share of shortest paths (by length) through each node, over the pairs of other nodes."""
    graph = defaultdict(list)
    for i, j, length in edges:
        graph[i].append((j, length))
        graph[j].append((i, length))
    score = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        dist, paths, before = {s: 0.0}, defaultdict(float, {s: 1.0}), defaultdict(list)
        heap, done = [(0.0, s)], []
        closed = set()
        while heap:
            d, v = heapq.heappop(heap)
            if v in closed:
                continue
            closed.add(v)
            done.append(v)
            for w, length in graph[v]:
                n = d + length
                if w not in dist or n < dist[w] - 1e-12:
                    dist[w], paths[w], before[w] = n, paths[v], [v]
                    heapq.heappush(heap, (n, w))
                elif abs(n - dist[w]) <= 1e-12 and w not in closed:
                    paths[w] += paths[v]
                    before[w].append(v)
        share = defaultdict(float)
        for w in reversed(done):
            for v in before[w]:
                share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                score[w] += share[w]
    n = len(nodes)
    scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    return {k: v * scale for k, v in score.items()}


def labelled_regions(cells: np.ndarray, least: int) -> np.ndarray:
    """4-connected components of a boolean grid: 0 outside, else numbers from 1 in row order of regions of at least ``least`` cells."""
    out = np.zeros(cells.shape, int)
    seen = np.zeros(cells.shape, bool)
    k = 0
    for start in zip(*np.nonzero(cells)):
        if seen[start]:
            continue
        stack, part = [start], []
        seen[start] = True
        while stack:
            i, j = stack.pop()
            part.append((i, j))
            for a, b in ((i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)):
                if 0 <= a < cells.shape[0] and 0 <= b < cells.shape[1] and cells[a, b] and not seen[a, b]:
                    seen[a, b] = True
                    stack.append((a, b))
        if len(part) >= least:
            k += 1
            for p in part:
                out[p] = k
    return out


def sphere(n: int) -> np.ndarray:
    """Evenly spread unit vectors on a golden spiral."""
    i = np.arange(n) + 0.5
    z, phi = 1 - 2 * i / n, np.pi * (1 + 5**0.5) * i
    r = np.sqrt(1 - z * z)
    return np.stack([r * np.cos(phi), r * np.sin(phi), z], 1)


def accessible_area(xyz: np.ndarray, radius: np.ndarray, probe: float = 1.4, points: int = 96) -> np.ndarray:
    """Surface of each atom that a probe sphere can reach (Shrake-Rupley), atom by atom against its neighbours from a cell list."""
    unit, reach = sphere(points), radius + probe
    out = 4 * np.pi * reach**2
    number = np.zeros(len(xyz), np.int64)
    i, j, d = pairs_in_frames(xyz, None, number, None, 2 * float(reach.max(initial=0.0)), strict=True)
    touch = d < reach[i] + reach[j]
    i, j = np.concatenate([i[touch], j[touch]]), np.concatenate([j[touch], i[touch]])
    order = np.argsort(i, kind="stable")
    at = np.searchsorted(i[order], np.arange(len(xyz) + 1))
    for k in np.flatnonzero(np.diff(at)):
        near = j[order[at[k] : at[k + 1]]]
        p = xyz[k] + reach[k] * unit
        out[k] *= 1 - (((p[:, None] - xyz[near][None]) ** 2).sum(2) < reach[near] ** 2).any(1).mean()
    return out
