"""Average linkage by rounds against merging the closest pair again and again, and against the kernel of one task."""

import pathlib

import numpy as np
import pytest

from strandlake.kernels import linear
from strandlake.operators import dynamics, linkage
from strandlake.session import shared_dir

RNG = np.random.default_rng(11)
SETS = ("geometry", "sidechain", "interaction")
SCHEMA = "traj_id string, frame int, " + ", ".join(f"{s} array<double>" for s in SETS)


def features(n, centres, noise=0.5):
    c = RNG.normal(size=(centres, 9)) * 3
    x = c[RNG.integers(0, centres, n)] + RNG.normal(size=(n, 9)) * noise
    return x[:, :3], x[:, 3:6], x[:, 6:]


def blended(x, weights=(0.45, 0.25, 0.30)):
    total = 0.0
    for k, w in enumerate(weights):
        diff = x[k][:, None] - x[k][None]
        d = np.abs(diff).sum(2) if k == 2 else np.sqrt((diff**2).sum(2))
        total = total + w * (d / d.max() if d.max() > 0 else d)
    return total


def by_hand(d, cutoff):
    groups = [[i] for i in range(len(d))]
    while len(groups) > 1:
        best = min((d[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if best[0] > cutoff:
            break
        groups[best[1]] += groups.pop(best[2])
    groups.sort(key=min)
    return {f: k for k, g in enumerate(groups) for f in g}


def table(spark, data):
    rows = [(t, f * 5, *(x[k][f].tolist() for k in range(3))) for t, x in data.items() for f in range(len(x[0]))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def clusters(df):
    got = {}
    for r in df.collect():
        assert (r["frame"] // 5) not in got.setdefault(r["traj_id"], {})
        got[r["traj_id"]][r["frame"] // 5] = r["cluster"]
    return got


@pytest.mark.parametrize("cutoff", [0.02, 0.2, 0.35, 2.0])
def test_rounds_equal_closest_pairs(spark, cutoff):
    data = {"few": features(45, 4), "spread": features(30, 30), "one": features(1, 1), "same": tuple(np.ones((12, 3)) for _ in range(3))}
    rows = linkage.distance_rows(table(spark, data), dict(zip(SETS, (0.45, 0.25, 0.30))), ("interaction",), tile_bytes=2500)
    got = clusters(linkage.average_linkage(rows, cutoff, tile_bytes=2500))
    assert got == {t: by_hand(blended(x), cutoff) for t, x in data.items()}


def test_long_trajectories_leave_the_task(spark):
    """500 frames in rounds, the others in their task: the kernel's clusters for both."""
    data = {"long": features(500, 9, 0.8), "short": features(40, 3)}
    got = clusters(dynamics.frame_clusters(table(spark, data), most=100))
    for t, x in data.items():
        assert [got[t][f] for f in range(len(x[0]))] == linear.average_linkage(blended(x), 0.35).tolist()
    assert len(set(got["long"].values())) > 1


def test_mutual_pairs():
    near = lambda d: linkage.mutual(*linkage.nearest_row(np.array(d, float)), 1.0).tolist()
    inf = np.inf
    assert near([[inf, 0.5, 3], [0.5, inf, 0.7], [3, 0.7, inf]]) == [0, 0, 2]
    assert near([[inf, 5, 3], [5, inf, 7], [3, 7, inf]]) == [0, 1, 2]
    assert near([[inf, 1, 1], [1, inf, 1], [1, 1, inf]]) == [0, 0, 2]
    # rounded differently on both sides: each names the next one, and still one pair merges
    assert near([[inf, 0.1, 0.2], [0.2, inf, 0.1], [0.1, 0.2, inf]]) == [0, 0, 2]
    assert near([[inf]]) == [0]


def test_none(spark):
    assert dynamics.frame_clusters(table(spark, {"few": features(5, 1)}).where("false")).count() == 0


@pytest.mark.parametrize("cutoff, few", [(0.02, 0), (0.35, 0), (0.35, 20), (2.0, 6)])
def test_rounds_from_frames_equal_closest_pairs(spark, cutoff, few):
    data = {"few": features(45, 4), "spread": features(30, 30), "one": features(1, 1), "same": tuple(np.ones((12, 3)) for _ in range(3))}
    got = clusters(linkage.linked_frames(table(spark, data), dict(zip(SETS, (0.45, 0.25, 0.30))), cutoff, ("interaction",), tile_frames=7, few=few))
    assert got == {t: by_hand(blended(x), cutoff) for t, x in data.items()}


def test_long_trajectories_keep_no_distances(spark):
    """All that is written for a long trajectory grows with its frames, not with their pairs."""
    folder = pathlib.Path(shared_dir(spark))
    written = lambda: sum(p.stat().st_size for p in folder.rglob("*.parquet"))
    rows, before = table(spark, {"long": features(1500, 60, 1.0)}), written()
    got = clusters(dynamics.frame_clusters(rows, most=100))
    assert written() - before < 1500 * 1500 * 8 / 8
    assert got == clusters(dynamics.frame_clusters(rows, most=2000))
