"""Kernels on small graphs, grids and spheres with known answers."""

import numpy as np
import pytest

from strandlake.kernels import graph, neighbours


def test_two_cliques_are_two_communities():
    edges = [(a, b, 1.0) for g in ((0, 1, 2, 3), (4, 5, 6, 7)) for a in g for b in g if a < b] + [(3, 4, 0.1)]
    label = graph.communities(list(range(8)), edges)
    assert [label[i] for i in range(8)] == [0] * 4 + [1] * 4
    assert graph.modularity(edges, label) > 0.45


def test_betweenness_of_a_path_and_a_square():
    path = graph.betweenness([0, 1, 2], [(0, 1, 1.0), (1, 2, 1.0)])
    assert path == {0: 0, 1: pytest.approx(1.0), 2: 0}
    square = graph.betweenness(list(range(4)), [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (0, 3, 1.0)])
    assert all(v == pytest.approx(1 / 6) for v in square.values())


def test_regions():
    cells = np.array([[1, 1, 0], [0, 1, 0], [1, 0, 1]], bool)
    assert graph.labelled_regions(cells, 2).tolist() == [[1, 1, 0], [0, 1, 0], [0, 0, 0]]


def test_area_of_one_and_of_two_spheres():
    one = graph.accessible_area(np.zeros((1, 3)), np.array([1.6]))
    assert one[0] == pytest.approx(4 * np.pi * 9)
    two = graph.accessible_area(np.array([[0.0, 0, 0], [3.0, 0, 0]]), np.array([1.6, 1.6]), points=2000)
    assert two == pytest.approx([2 * np.pi * 3 * (3 + 1.5)] * 2, rel=0.01)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("box", [None, (4.0, 5.0, 6.0)])
def test_near_pairs_in_frames(strict, box):
    rng = np.random.default_rng(4)
    a, b = np.round(rng.normal(size=(90, 3)) * 3, 1), np.round(rng.normal(size=(70, 3)) * 3, 1)
    fa, fb = np.sort(rng.integers(0, 6, 90)), np.sort(np.append(rng.integers(1, 9, 69), 3))
    want = []
    for i in range(90):
        for j in range(70):
            d = a[i] - b[j]
            d = d - np.round(d / box) * box if box else d
            d = np.sqrt((d * d).sum())
            if fa[i] == fb[j] and (d < 2.5 if strict else d <= 2.5):
                want.append((i, j))
    for small in (0, 100, 10**6):
        i, j, _ = neighbours.pairs_in_frames(a, b, fa, fb, 2.5, strict, box, small)
        assert sorted(zip(i.tolist(), j.tolist())) == want
        i, j, _ = neighbours.pairs_in_frames(a, None, fa, None, 2.5, strict, box, small)
        x, y, _ = neighbours.pairs_in_frames(a, a, fa, fa, 2.5, strict, box, 10**6)
        assert sorted((min(p), max(p)) for p in zip(i.tolist(), j.tolist())) == sorted((p, q) for p, q in zip(x.tolist(), y.tolist()) if p < q)
    none = np.empty((0, 3)), np.empty(0, np.int64)
    assert all(len(x) == 0 for x in neighbours.pairs_in_frames(none[0], b, none[1], fb, 2.5))


def test_cells_meet_only_what_is_near():
    """At equal density the distances computed grow with the atoms, not with their square; a far outlier and a box of few cells lose nothing."""
    rng = np.random.default_rng(2)
    met = []
    for n in (800, 6500):
        p = rng.uniform(0, (n / 0.05) ** (1 / 3), (n, 3))
        frame = np.zeros(n, np.int64)
        met.append(sum(len(i) for i, _ in neighbours.cell_candidates(p, p, frame, frame, 4.5)))
        once = sum(len(i) for i, _ in neighbours.cell_candidates(p, p, frame, frame, 4.5, once=True))
        assert met[-1] / 2 == pytest.approx(once, abs=n)
    assert met[1] / met[0] < 1.4 * 6500 / 800 < 6500**2 / met[1]
    p[0] = 1e7
    i, j, _ = neighbours.pairs_in_frames(p, p, frame, frame, 4.5)
    x, y, _ = neighbours.pairs_in_frames(p, p, frame, frame, 4.5, small=10**9)
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(zip(x.tolist(), y.tolist()))
