"""Nearest clusters by bounds against all mean distances."""

import pathlib

import numpy as np
import pytest

from strandlake.kernels import clusters
from strandlake.operators import linkage
from strandlake.session import shared_dir

WEIGHTS = (0.45, 0.25, 0.30)


def side(rng, frames, n, spread, noise=0.4):
    label = np.sort(rng.integers(0, n, frames))
    _, starts, sizes = np.unique(label, return_index=True, return_counts=True)
    x = rng.normal(size=(n, 18))[label] * spread + rng.normal(size=(frames, 18)) * noise
    return clusters.Side(x, starts, sizes)


def feature_sets(*sides):
    x = np.concatenate([s.x for s in sides])
    at = [slice(k, k + 6) for k in (0, 6, 12)]
    return [clusters.Set(a, w, clusters.largest(x[:, a], x[:, a], k == 2), k == 2) for k, (a, w) in enumerate(zip(at, WEIGHTS))]


def all_means(one, two, sets, same):
    d = np.concatenate([d for _, d in clusters.distance_blocks(one.x, two.x, sets)])
    d = np.add.reduceat(np.add.reduceat(d, one.starts, 0), two.starts, 1) / one.sizes[:, None] / two.sizes
    if same:
        np.fill_diagonal(d, np.inf)
    return d


@pytest.mark.parametrize("frames, n, spread, cutoff", [(300, 4000, 1, 0.3), (700, 200, 1, 0.35), (700, 40, 0.5, 0.5), (500, 4, 0.5, 0.9), (1, 1, 1, 1.0), (400, 100, 0, 0.4), (300, 30, 1, 0.01)])
def test_nearest_equals_all_means(monkeypatch, frames, n, spread, cutoff):
    monkeypatch.setattr(clusters, "ROWS", 16)
    monkeypatch.setattr(clusters, "COLUMNS", 64)
    monkeypatch.setattr(clusters, "PAIRS", 900)
    monkeypatch.setattr(clusters, "MANY", 200)
    rng = np.random.default_rng(n)
    one, two = side(rng, frames, n, spread), side(rng, frames // 2 + 1, n, spread)
    sets = feature_sets(one, two)
    for same in (False, True):
        other = one if same else two
        want = all_means(one, other, sets, same)
        got = clusters.nearest(one, other, sets, cutoff, same, not same)
        assert len(got) == 2 - same
        for (of, near, value), d in zip(got, (want, want.T)):
            has = np.flatnonzero(d.min(1) <= cutoff)
            assert of.tolist() == has.tolist() and near.tolist() == d.argmin(1)[has].tolist()
            assert value == pytest.approx(d.min(1)[has], abs=1e-13)


def test_bounds_hold_and_leave_few(monkeypatch):
    rng = np.random.default_rng(2)
    one, two = side(rng, 1200, 400, 0.8), side(rng, 900, 300, 0.8)
    sets = feature_sets(one, two)
    d = all_means(one, two, sets, False)
    r, c = (v.ravel() for v in np.indices(d.shape))
    centre = np.concatenate([one.x, two.x]).mean(0)
    low = clusters.lower_bounds(*([clusters._moments(s, f, centre) for f in sets] for s in (one, two)), sets, r, c)
    assert (low <= d.ravel() + 1e-12).all() and (low / d.ravel()).mean() > 0.95
    met, measure = [], clusters.mean_distances

    def counted(one, two, sets, r, c):
        met.append(int((one.sizes[r] * two.sizes[c]).sum()))
        return measure(one, two, sets, r, c)

    monkeypatch.setattr(clusters, "mean_distances", counted)
    clusters.nearest(one, two, sets, 0.35, False, True)
    assert 0 < sum(met) < 0.1 * len(one.x) * len(two.x)


def test_largest_of_frames_near_the_centre_and_on_a_sphere():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 5))
    for v in (x, x / np.linalg.norm(x, axis=1)[:, None], x[:1], x[:0], np.ones((4, 5))):
        for manhattan in (False, True):
            diff = v[:, None] - v[None]
            want = (np.abs(diff).sum(2) if manhattan else np.sqrt((diff**2).sum(2))).max(initial=0)
            assert clusters.largest(v, v, manhattan) == pytest.approx(want, rel=1e-12)


def test_equal_frames_take_no_rounds(spark):
    """Thirty copies of each of twelve frames: not a round for each copy."""
    rng = np.random.default_rng(5)
    x = np.tile(np.round(rng.normal(size=(12, 6)), 3), (30, 1))
    rows = [("a", f, v[:2].tolist(), v[2:4].tolist(), v[4:].tolist()) for f, v in enumerate(x)]
    sets = ("geometry", "sidechain", "interaction")
    table = spark.createDataFrame(rows, "traj_id string, frame int, " + ", ".join(f"{s} array<double>" for s in sets))
    rounds = lambda: len(list(pathlib.Path(shared_dir(spark)).glob("linkage-*")))
    before = rounds()
    got = {r["frame"]: r["cluster"] for r in linkage.linked_frames(table, dict(zip(sets, WEIGHTS)), 0.0, ("interaction",), tile_frames=50, few=0).collect()}
    assert got == {f: f % 12 for f in range(360)}
    assert rounds() - before <= 3
