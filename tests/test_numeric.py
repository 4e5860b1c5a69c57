"""Operators whose last step is numeric, end to end against independent numpy computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import statistics
from strandlake.kernels import alignment, linear
from strandlake.operators import dynamics, geometry, landscape, library, moments, profiles, rings, series, summaries

RNG = np.random.default_rng(20)
SHAPES = {"a": (37, 6), "b": (64, 6), "c": (11, 6)}


@pytest.fixture(scope="module")
def motion():
    """Trajectories of six atoms that move along a slow wave, with noise and rigid moves."""
    out = {}
    for t, (n, atoms) in SHAPES.items():
        base, wave = RNG.normal(size=(atoms, 3)) * 5, RNG.normal(size=(atoms, 3))
        move = np.cos(np.pi * np.arange(n) / n)[:, None, None] * wave * 1.5
        out[t] = base + move + RNG.normal(size=(n, atoms, 3)) * 0.3 + RNG.normal(size=(n, 1, 3))
    return out


@pytest.fixture(scope="module")
def frames(spark, motion):
    rows = [(t, f, x[f].ravel().tolist()) for t, x in motion.items() for f in range(len(x))]
    return spark.createDataFrame(rows, "traj_id string, frame int, xyz array<double>").repartition(5)


def kabsch(p, q):
    """RMSD of q fitted onto p, by the singular value decomposition of one pair."""
    a, b = p - p.mean(0), q - q.mean(0)
    u, s, vt = np.linalg.svd(b.T @ a)
    s[-1] *= np.sign(np.linalg.det(u @ vt))
    return math.sqrt(max((a * a).sum() + (b * b).sum() - 2 * s.sum(), 0) / len(a))


def fitted(x):
    out = []
    for f in x:
        a, b = f - f.mean(0), x[0] - x[0].mean(0)
        u, _, vt = np.linalg.svd(a.T @ b)
        d = np.diag([1, 1, np.sign(np.linalg.det(u @ vt))])
        out.append(a @ u @ d @ vt + x[0].mean(0))
    return np.array(out)


def test_fitted_rmsd_of_awkward_frames():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(9, 7, 3))
    x[1] = x[0]  # equal
    x[2] = x[0] * [1, 1, -1]  # a mirror image
    x[3, :, 2] = 0  # in a plane
    x[4, :, 1:] = 0  # on a line
    x[5] = 0  # in a point
    x[6] = x[0] + 1e-9
    got = linear.fitted_rmsd(x, x)
    want = np.array([[kabsch(a, b) for b in x] for a in x])
    assert got == pytest.approx(want, abs=2e-6)


def test_rmsd_series_and_regions(frames, motion):
    got = {(r["traj_id"], r["frame"]): r["rmsd"] for r in geometry.rmsd_series(frames).collect()}
    want = {(t, f): kabsch(x[0], x[f]) for t, x in motion.items() for f in range(len(x))}
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}
    fit, part = [0, 1, 2, 3], [4, 5]
    regions = {(r["traj_id"], r["frame"]): r["tail"] for r in geometry.region_rmsd(frames, fit, {"tail": part}).collect()}
    for t, x in motion.items():
        for f in range(len(x)):
            a, b = x[f][fit], x[0][fit]
            u, _, vt = np.linalg.svd((a - a.mean(0)).T @ (b - b.mean(0)))
            rot = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt))]) @ vt
            moved = (x[f] - a.mean(0)) @ rot + b.mean(0)
            assert regions[t, f] == pytest.approx(math.sqrt(((moved[part] - x[0][part]) ** 2).sum(1).mean()), abs=1e-6)


def test_medoids_against_all_pairs(frames, motion):
    g = frames.withColumn("complex_id", F.lit("all"))
    got = {(r["traj_id"], r["frame"]): (r["mean_rmsd"], r["own_mean_rmsd"]) for r in dynamics.medoids(g, "complex_id", tile=20).collect()}
    flat = [(t, f, x[f]) for t, x in motion.items() for f in range(len(x))]
    for t, f, x in flat:
        d = [(kabsch(x, y), t == s) for s, _, y in flat]
        own = [v for v, same in d if same]
        assert got[t, f] == (pytest.approx(sum(v for v, _ in d) / len(flat), abs=1e-6), pytest.approx(sum(own) / len(own), abs=1e-6))


def test_medoids_of_many_tiles_send_frames_a_bounded_number_of_times(spark):
    """300 frames in tiles of 2: not 150 copies of a frame, and not one task for the whole group."""
    x = RNG.normal(size=(300, 4, 3))
    x[200:220] = x[7]  # equal frames
    frames = spark.createDataFrame([("all", "ab"[f % 2], f, x[f].ravel().tolist()) for f in range(300)], "complex_id string, traj_id string, frame int, xyz array<double>")
    given = frames.withColumns({"w": F.lit(1), "wanted": F.lit(True)})
    met = dynamics._meetings(given, "complex_id", tile=2, tiles=5, most=1000)
    assert met.count() == 5 * 300
    assert met.select(F.spark_partition_id().alias("k"), "a", "b").distinct().groupBy("k").count().count() > 4
    assert dynamics._meetings(given, "complex_id", tile=2, tiles=5, most=30).count() == 10 * 300
    few = given.withColumn("wanted", F.col("frame") < 3)  # two tiles of these, five of the others
    assert dynamics._meetings(few, "complex_id", tile=2, tiles=5, most=1000).count() == 3 * 7 + 297 * 2
    d = linear.fitted_rmsd(x, x)
    got = {r["frame"]: (r["mean_rmsd"], r["own_mean_rmsd"]) for r in dynamics.medoids(frames, "complex_id", tile=2, tiles=5).collect()}
    assert got == {f: (pytest.approx(d[f].mean(), abs=1e-7), pytest.approx(d[f, f % 2 :: 2].mean(), abs=1e-7)) for f in range(300)}


def test_least_rmsd_bounds_from_below():
    rng = np.random.default_rng(8)
    base = rng.normal(size=(30, 3)) * [9, 5, 3]
    moved = np.stack([base + rng.normal(size=(30, 3)) * rng.uniform(0.01, 2) for _ in range(90)]) @ np.linalg.qr(rng.normal(size=(90, 3, 3)))[0]
    awkward = rng.normal(size=(60, 7, 3))
    awkward[10:20, :, 2], awkward[20:30, :, 1:], awkward[30], awkward[36:40] = 0, 0, 0, awkward[0] * [1, 1, -1]
    awkward[44:50] *= 1e-3
    for x in (rng.normal(size=(100, 21, 3)), moved, awkward):
        exact, low = linear.fitted_rmsd(x, x), np.zeros((len(x), len(x)))
        for i, j, d in linear.least_rmsd_blocks(x, x, rows=7, cols=40):
            low[i : i + d.shape[0], j : j + d.shape[1]] = d
        assert (low <= exact).all()
        assert x is awkward or (low.mean(1) > 0.98 * exact.mean(1)).all()


def test_ensemble_medoids_equal_the_least_of_all_means(spark):
    """Whole and by tiles, with equal frames, with groups of one frame, of mixed atoms, and with no pair that bounds tell apart."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(6, 3)) * 4
    rows = [("near", "abc"[f % 3], f, (base + rng.normal(size=(6, 3)) * rng.uniform(0.1, 1)).ravel().tolist()) for f in range(120)]
    rows += [("far", "d", f, rng.normal(size=12).tolist()) for f in range(80)] + [("far", "e", f, rows[0][3]) for f in range(9)]
    rows += [("one", "f", 3, rng.normal(size=9).tolist())] + [("same", "gh"[f % 2], f, [1.0, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.0, 3.0]) for f in range(20)]
    frames = spark.createDataFrame(rows, "complex_id string, traj_id string, frame int, xyz array<double>")
    want = {r["complex_id"]: r for r in dynamics.pick_medoids(dynamics.medoids(frames, "complex_id"), "complex_id").collect()}
    for how in ({}, {"tile": 8, "tiles": 4, "most": 1000}):
        got = {r["complex_id"]: r for r in dynamics.ensemble_medoids(frames, "complex_id", **how).collect()}
        assert got.keys() == want.keys()
        for k, r in got.items():
            assert (r["traj_id"], r["frame"], r["n_frames"]) == (want[k]["traj_id"], want[k]["frame"], want[k]["n_frames"])
            assert r["mean_rmsd"] == pytest.approx(want[k]["mean_rmsd"], abs=1e-9)
        assert dynamics.ensemble_medoids(frames, "complex_id", **how).columns == ["complex_id", "traj_id", "frame", "mean_rmsd", "n_frames"]


def test_second_moments_whatever_the_partitions(spark, monkeypatch):
    x = {k: RNG.normal(size=(n, 7)) + 100 for k, n in (("a", 90), ("b", 1), ("c", 40))}
    rows = [(k, v.tolist()) for k, m in x.items() for v in m]
    monkeypatch.setattr(moments, "_ROW", 14)
    monkeypatch.setattr(moments, "_HELD", 60)
    df = spark.createDataFrame(rows, "traj_id string, vector array<double>").repartition(6)
    got = {(r["traj_id"], r["a"], r["b"]): (r["n"], r["cov"]) for r in moments.covariances(moments.second_moments(df, "traj_id", "vector"), "traj_id").collect()}
    assert len(got) == 3 * 49
    for k, m in x.items():
        want = np.cov(m.T, bias=True) if len(m) > 1 else np.zeros((7, 7))
        for a in range(7):
            for b in range(7):
                assert got[k, a, b] == (len(m), pytest.approx(want[a, b], abs=1e-8))


def test_cross_correlation(frames, motion):
    got = {(r["traj_id"], r["i"], r["j"]): (r["cov"], r["v"]) for r in dynamics.cross_correlation(frames).collect()}
    for t, x in motion.items():
        d = x - x.mean(0)
        c = np.einsum("fid,fjd->ij", d, d) / len(x)
        for i in range(6):
            for j in range(i, 6):
                assert got[t, i, j] == (pytest.approx(c[i, j], abs=1e-8), pytest.approx(c[i, j] / math.sqrt(c[i, i] * c[j, j]), abs=1e-8))


def test_collective_modes(frames, motion):
    got = {r["traj_id"]: r for r in dynamics.collective_modes(frames).collect()}
    for t, x in motion.items():
        d = x - x.mean(0)
        w = np.sort(np.linalg.eigvalsh(np.einsum("fid,fjd->ij", d, d) / len(x)))[::-1]
        n = int(np.searchsorted(np.cumsum(w) / w.sum(), 0.9)) + 1
        p = w[w > 0] / w.sum()
        assert got[t]["n_modes_90"] == n and got[t]["trace"] == pytest.approx(w.sum())
        assert got[t]["collectivity"] == pytest.approx(np.exp(-(p * np.log(p)).sum()) / 6, abs=1e-6)


@pytest.mark.parametrize("tile_bytes", [1 << 20, 9000, 3000])
def test_modes_by_inner_products_equal_those_by_covariance(spark, tile_bytes):
    """Fewer frames than coordinates, in one task and in tiles, beside longer, still and single-frame trajectories."""
    rng = np.random.default_rng(11)
    x = {"few": rng.normal(size=(25, 20, 3)), "long": rng.normal(size=(40, 4, 3)), "still": np.repeat(rng.normal(size=(1, 9, 3)), 5, 0), "one": rng.normal(size=(1, 9, 3))}
    x["few"] += np.cos(np.pi * np.arange(25) / 25)[:, None, None] * rng.normal(size=(20, 3)) * 2
    rows = [(t, f, m[f].ravel().tolist()) for t, m in x.items() for f in range(len(m))]
    df = spark.createDataFrame(rows, "traj_id string, frame int, xyz array<double>").repartition(4)
    got = {r["traj_id"]: r for r in dynamics.essential_dynamics(df, 5, tile_bytes).collect()}
    assert set(got) == set(x)
    for t in ("few", "long"):
        y = fitted(x[t]).reshape(len(x[t]), -1)
        d = y - y.mean(0)
        _, s, vt = np.linalg.svd(d, full_matrices=False)
        p = d @ vt[0]
        assert got[t]["variance_share"] == pytest.approx(s[0] ** 2 / (s**2).sum(), abs=1e-9)
        assert got[t]["cosine_content"] == pytest.approx(2 / len(y) * (np.cos(np.pi * np.arange(len(y)) / len(y)) @ p) ** 2 / (p @ p), abs=1e-8)
        m = np.array(got[t]["modes"]).reshape(5, -1)
        assert np.abs(m @ vt[:5].T) == pytest.approx(np.eye(5), abs=1e-6) and m @ m.T == pytest.approx(np.eye(5), abs=1e-8)
    for t in ("still", "one"):
        assert (got[t]["variance_share"], got[t]["cosine_content"], got[t]["n_atoms"]) == (pytest.approx(0, abs=1), None, 9) or t == "still"
    assert dynamics.essential_dynamics(df.where("frame < 0")).collect() == []


def test_too_many_frames_for_inner_products(spark):
    df = spark.createDataFrame([("a", f, [float(f + k * k) for k in range(30)]) for f in range(12)], "traj_id string, frame int, xyz array<double>")
    with pytest.raises(Exception, match="too many frames"):
        dynamics.essential_dynamics(df, tile_bytes=500, most=10).collect()


def test_essential_dynamics_and_overlap(spark, frames, motion):
    got = {r["traj_id"]: r for r in dynamics.essential_dynamics(frames, 4).collect()}
    modes = {}
    for t, x in motion.items():
        y = fitted(x).reshape(len(x), -1)
        d = y - y.mean(0)
        _, s, vt = np.linalg.svd(d, full_matrices=False)
        modes[t] = vt[:4]
        p = d @ vt[0]
        content = 2 / len(x) * (np.cos(np.pi * np.arange(len(x)) / len(x)) @ p) ** 2 / (p @ p)
        assert got[t]["variance_share"] == pytest.approx(s[0] ** 2 / (s**2).sum(), abs=1e-9)
        assert got[t]["cosine_content"] == pytest.approx(content, abs=1e-8)
        assert np.abs(np.array(got[t]["modes"]).reshape(4, -1) @ vt[:4].T) == pytest.approx(np.eye(4), abs=1e-6)
    found = {r["traj_id"]: r["rmsip"] for r in dynamics.subspace_overlap(spark.createDataFrame(list(got.values())).withColumn("complex_id", F.lit("x")), "complex_id").collect()}
    pair = lambda a, b: math.sqrt(((modes[a] @ modes[b].T) ** 2).sum() / 4)
    for t in modes:
        assert found[t] == pytest.approx(np.mean([pair(t, u) for u in modes if u != t]), abs=1e-6)


@pytest.fixture(scope="module")
def wide():
    mix = RNG.normal(size=(5, 5))
    return {t: np.cumsum(RNG.normal(size=(n, 5)), 0) @ mix for t, n in (("a", 80), ("b", 45))}


@pytest.fixture(scope="module")
def features(spark, wide):
    rows = [(t, f, j, float(x[f, j])) for t, x in wide.items() for f in range(len(x)) for j in range(5)]
    rows.append(("a", 999, 0, 5.0))  # a frame that lacks features
    return spark.createDataFrame(rows, "traj_id string, frame int, j int, x double").repartition(4)


def test_principal_components(features, wide):
    full = features.where("frame < 999")
    got = {(r["traj_id"], r["frame"], r["component"]): (r["score"], r["share"]) for r in landscape.principal_components(full).collect()}
    for t, x in wide.items():
        z = (x - x.mean(0)) / x.std(0)
        _, s, vt = np.linalg.svd(z, full_matrices=False)
        for k in range(2):
            v = vt[k] * np.sign(vt[k][np.abs(vt[k]).argmax()])
            for f in range(len(x)):
                assert got[t, f, k] == (pytest.approx(z[f] @ v, abs=1e-7), pytest.approx(s[k] ** 2 / (s**2).sum(), abs=1e-9))


def test_tica(features, wide):
    full = features.where("frame < 999")
    got = {}
    for r in landscape.tica(full, 3, kinetic_map=False).collect():
        got.setdefault((r["traj_id"], r["component"]), {"value": r["eigenvalue"], "scale": r["timescale"]})[r["j"]] = r["weight"]
    for t, x in wide.items():
        z = (x - x.mean(0)) / x.std(0)
        a, b = z[:-3] - z[:-3].mean(0), z[3:] - z[3:].mean(0)
        n = len(a) - 1
        c0 = 0.5 * (a.T @ a + b.T @ b) / n + 1e-6 * np.eye(5)
        ct = 0.5 * (a.T @ b + b.T @ a) / n
        values = np.sort(np.linalg.eigvals(np.linalg.solve(c0, ct)).real)[::-1]
        for k in range(2):
            assert got[t, k]["value"] == pytest.approx(values[k], abs=1e-7)
            v = np.array([got[t, k][j] for j in range(5)])
            assert ct @ v == pytest.approx(values[k] * (c0 @ v), abs=1e-7)
            if 0 < values[k] < 1:
                assert got[t, k]["scale"] == pytest.approx(-3 / math.log(values[k]), rel=1e-6)


def test_kernel_density_and_basins(spark):
    centres = np.array([[0, 0], [6, 1], [2, 7]])
    x = np.concatenate([RNG.normal(size=(n, 2)) * 0.7 + c for c, n in zip(centres, (120, 70, 40))])
    x = x[RNG.permutation(len(x))]
    rows = [("t", f, float(a), float(b)) for f, (a, b) in enumerate(x)] + [("line", f, float(f), 2.0 * f) for f in range(30)] + [("few", f, float(f % 2), float(f)) for f in range(5)]
    df = spark.createDataFrame(rows, "traj_id string, frame int, u double, v double").repartition(3)
    grid = {(r["ix"], r["iy"]): r for r in landscape.kernel_density(df, "u", "v", 30).collect()}
    cov = np.cov(x.T) * len(x) ** (-1 / 3)
    inv, norm = np.linalg.inv(cov), 2 * np.pi * math.sqrt(np.linalg.det(cov)) * len(x)
    lo, hi = x.min(0), x.max(0)
    axes = [np.linspace(lo[k] - 0.1 * (hi - lo)[k], hi[k] + 0.1 * (hi - lo)[k], 30) for k in (0, 1)]
    assert len(grid) == 900
    for (i, j), r in grid.items():
        d = x - [axes[0][i], axes[1][j]]
        assert (r["x"], r["y"]) == (pytest.approx(axes[0][i]), pytest.approx(axes[1][j]))
        assert r["density"] == pytest.approx(np.exp(-0.5 * np.einsum("na,ab,nb->n", d, inv, d)).sum() / norm, rel=1e-9, abs=1e-300)
    got = sorted(landscape.kde_basins(df, "u", "v", most=4).collect(), key=lambda r: r["basin"])
    assert {r["traj_id"] for r in got} == {"t"} and len(got) == 3
    near = [int(((centres - [r["x"], r["y"]]) ** 2).sum(1).argmin()) for r in got]
    assert near[0] == 0 and sorted(near) == [0, 1, 2] and got[0]["dg"] == 0
    own = ((x[:, None] - [[r["x"], r["y"]] for r in got]) ** 2).sum(2)
    for k, r in enumerate(got):
        inside = own.argmin(1) == k
        assert r["population"] == pytest.approx(inside.mean()) and r["frame"] == np.flatnonzero(inside)[own[inside, k].argmin()]


def test_substates(spark):
    x = {t: np.concatenate([RNG.normal(size=(n, 2)) + c for c, n in zip(((0, 0), (5, 0), (0, 6)), sizes)]) for t, sizes in (("a", (30, 20, 4)), ("b", (9, 9, 9)))}
    x["one"] = np.ones((4, 2))
    rows = [(t, f, *map(float, v)) for t, m in x.items() for f, v in enumerate(m)]
    got = {(r["traj_id"], r["frame"]): r for r in landscape.substates(spark.createDataFrame(rows, "traj_id string, frame int, p double, q double"), ("p", "q")).collect()}
    assert len(got) == len(rows)
    for t, m in x.items():
        state = np.array([got[t, f]["state"] for f in range(len(m))])
        # seeds by distance, then plain rounds
        seeds = [m[((m - m.mean(0)) ** 2).sum(1).argmin()]]
        while len(seeds) < 3:
            seeds.append(m[np.min([((m - s) ** 2).sum(1) for s in seeds], axis=0).argmax()])
        c = np.array(seeds)
        for _ in range(50):
            label = ((m[:, None] - c) ** 2).sum(2).argmin(1)
            c = np.array([m[label == k].mean(0) if (label == k).any() else c[k] for k in range(3)])
        assert state.tolist() == label.tolist()
        for f in range(len(m)):
            share = (state == state[f]).mean()
            assert got[t, f]["population"] == pytest.approx(share) and got[t, f]["major"] == (share >= 0.1)


def test_docking_angles_from_singular_vectors(spark):
    x = RNG.normal(size=(40, 16, 3)) * 4
    sets = [list(range(6)), [6, 7, 8], [9, 10, 11], [12, 13, 14, 15]]
    df = spark.createDataFrame([("t", f, v.ravel().tolist()) for f, v in enumerate(x)], "traj_id string, frame int, xyz array<double>")
    for r in geometry.docking(df, *sets).collect():
        v = x[r["frame"]]
        g, a, b, p = (v[s] for s in sets)
        vt = np.linalg.svd(g - g.mean(0))[2]
        run, normal = p[-1] - p[0], vt[2]
        axis = max(vt[:2], key=lambda u: abs(u @ run))
        axis = axis if axis @ run >= 0 else -axis
        line = b.mean(0) - a.mean(0)
        flat = line - (line @ normal) * normal
        cos = flat @ axis / np.linalg.norm(flat)
        up = (a.mean(0) + b.mean(0)) / 2 - (g.mean(0) + p.mean(0)) / 2
        assert r["crossing"] == pytest.approx(np.degrees(np.arccos(abs(cos))), abs=1e-6)
        assert r["incident"] == pytest.approx(np.degrees(np.arccos(abs(up @ normal) / np.linalg.norm(up))), abs=1e-6)
        assert r["polarity"] == (0 if abs(cos) < 0.174 else np.sign(cos))
    for r in geometry.reference_docking(df, [0, 1, 2], [3, 4, 5], list(range(6)), list(range(6, 12))).collect():
        ref, v = x[0], x[r["frame"]]
        h1, h2 = (np.linalg.svd(ref[s] - ref[s].mean(0))[2][0] for s in ([0, 1, 2], [3, 4, 5]))
        along = h1 + (h2 if h1 @ h2 >= 0 else -h2)
        along /= np.linalg.norm(along)
        normal = np.cross(along, ref[[3, 4, 5]].mean(0) - ref[[0, 1, 2]].mean(0))
        normal /= np.linalg.norm(normal)
        aim = v[6:12].mean(0) - v[:6].mean(0)
        flat = aim - (aim @ normal) * normal
        assert r["crossing"] == pytest.approx(np.degrees(np.arccos(abs(flat @ along) / np.linalg.norm(flat))), abs=1e-6)
        assert r["incident"] == pytest.approx(np.degrees(np.arccos(abs(aim @ normal) / np.linalg.norm(aim))), abs=1e-6)


def test_view_axes(spark):
    """The receptor stands over the peptide, which runs along x: up is z, and the view looks along y."""
    heavy = np.array([[x, y, -2.0] for x in (-6, 0, 6) for y in (-1, 1)])
    light = np.array([[x, 6.0, -6.0] for x in (-1.0, 0, 1, 2, 3, 4, 5)])
    pep = np.array([[-3.0, 0, 0], [0, 0, 0], [3, 0, 0]])
    tcr = np.array([[x, y, 9.0] for x in (-2, 2) for y in (-1, 1)])
    light = light - light.mean(0) + [0, 0, -6]
    tcr2 = tcr + [0, 0, 3.0]
    v = np.concatenate([heavy, light, pep, tcr, tcr2])
    at = np.cumsum([0, 6, 7, 3, 4, 4])
    chains = [list(range(a, b)) for a, b in zip(at[:-1], at[1:])]
    r = geometry.view_axes(spark.createDataFrame([("t", 0, v.ravel().tolist())], "traj_id string, frame int, xyz array<double>"), chains).first()
    assert [r[f"up_{a}"] for a in "xyz"] == pytest.approx([0, 0, 1], abs=1e-9)
    assert [r[f"view_{a}"] for a in "xyz"] == pytest.approx([0, -1, 0], abs=1e-9)
    assert (r["half_width"], r["half_height"]) == (pytest.approx(6), pytest.approx(9))
    assert r["centre_z"] == pytest.approx(3)


def test_bulge(spark):
    x = RNG.normal(size=(12, 9, 3)) * 3
    df = spark.createDataFrame([("t", f, v.ravel().tolist()) for f, v in enumerate(x)], "traj_id string, frame int, xyz array<double>")
    for r in rings.peptide_bulge(df, [0, 1, 2, 3, 4], [6, 7, 8]).collect():
        v = x[r["frame"]]
        g = v[:5]
        normal = np.linalg.eigh((g - g.mean(0)).T @ (g - g.mean(0)))[1][:, 0]
        assert r["bulge"] == pytest.approx(max(abs((v[k] - g.mean(0)) @ normal) for k in (6, 7, 8)), abs=1e-8)


def test_exact_quantiles(spark):
    x = {"a": RNG.normal(size=501), "b": np.repeat([1.0, 2.0, 2.0, 9.0], 50), "c": np.array([4.0]), "hot": np.append(np.full(3000, 5.0), np.arange(0, 10, 0.01))}
    df = spark.createDataFrame([(k, float(v)) for k, m in x.items() for v in m] + [("a", None)], "name string, v double").repartition(7)
    got = {(r["name"], r["q"]): r["value"] for r in summaries.exact_quantiles(df, "name", "v", (0.0, 0.25, 0.5, 0.9, 1.0)).collect()}
    assert got == {(k, q): pytest.approx(np.quantile(m, q)) for k, m in x.items() for q in (0.0, 0.25, 0.5, 0.9, 1.0)}
    assert summaries.exact_quantiles(df.where("name = 'none'"), "name", "v", (0.5,)).collect() == []


def test_p_values(spark):
    cases = [(t, df) for t in (0.0, 0.3, 1.0, 2.5, 7.0, 40.0) for df in (1.0, 2.0, 3.0, 4.6, 11.0, 80.5)]
    got = spark.createDataFrame(cases, "t double, df double").select("t", "df", statistics.student_p(F.col("t"), F.col("df")).alias("p"), statistics.normal_p(F.col("t")).alias("q")).collect()
    for r in got:
        k, t = r["df"], r["t"]
        # by numeric integration over the angle: t = sqrt(df) tan(a)
        a = np.linspace(math.atan(t / math.sqrt(k)), math.pi / 2, 200_001)
        f = np.cos(a) ** (k - 1)
        p = 2 * np.trapezoid(f, a) * math.exp(math.lgamma((k + 1) / 2) - math.lgamma(k / 2)) / math.sqrt(math.pi)
        assert r["p"] == pytest.approx(p, rel=2e-5, abs=1e-12)
        assert r["q"] == pytest.approx(math.erfc(t / math.sqrt(2)), rel=1e-9, abs=1e-300)


def test_convergence_time(spark):
    noisy, calm = RNG.normal(size=150) * 20, RNG.normal(size=350)
    x = {"a": np.concatenate([noisy, calm]), "short": calm[:50], "never": np.concatenate([calm, noisy])}
    df = spark.createDataFrame([(t, f, float(v)) for t, m in x.items() for f, v in enumerate(m)], "traj_id string, frame int, value double")
    got = {r["traj_id"]: r["time"] for r in series.convergence_time(df).collect()}
    for t, m in x.items():
        n = len(m)
        if n < 100:
            assert got[t] is None
            continue
        w, hold = max(100, n // 20), max(100, n // 10)
        dev = np.array([m[max(0, i - w) : min(n, i + w)].std() for i in range(n)])
        limit = 1.2 * dev[int(n * 0.8) :].mean()
        first = next((i for i in range(w, n - w) if (dev[i : i + hold] <= limit).all()), None)
        assert got[t] == pytest.approx(n * 0.4 if first is None else first * 2.0)


def test_balanced_components(spark):
    x = RNG.normal(size=(60, 7)) * [9, 3, 1, 1, 0.1, 0.1, 0.1] + 4
    df = spark.createDataFrame([("t", f, v.tolist()) for f, v in enumerate(x)], "traj_id string, frame int, vector array<double>").repartition(4)
    got = {(r["frame"], r["component"]): (r["score"], r["share"]) for r in library.balanced_components(df, {"one": 3, "two": 1, "three": 3}).collect()}
    blocks = [x[:, :3], x[:, 3:4], x[:, 4:]]
    blocks = [(b - b.mean(0)) / np.linalg.svd(b - b.mean(0), compute_uv=False)[0] for b in blocks]
    u, s, vt = np.linalg.svd(np.concatenate(blocks, 1), full_matrices=False)
    for k in range(2):
        sign = np.sign(vt[k][np.abs(vt[k]).argmax()])
        for f in range(60):
            assert got[f, k] == (pytest.approx(u[f, k] * s[k] * sign, abs=1e-8), pytest.approx(s[k] ** 2 / (s**2).sum()))


def test_library_map(spark):
    n = 300
    hidden = RNG.normal(size=(n, 2))
    g = np.stack([hidden[:, 0] * k + 0.2 * RNG.normal(size=n) for k in (1, 2, -3)], 1)
    d = np.stack([hidden[:, 1] * k + 0.2 * RNG.normal(size=n) for k in (5, 1, 1, -2)], 1)
    names = ["g1", "g2", "g3", "d1", "d2", "d3", "d4"]
    x = np.concatenate([g, d], 1)
    rows = [(i, *(None if (i, j) in ((3, 1), (9, 6)) else float(v) for j, v in enumerate(r))) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "complex_id long, " + ", ".join(f"{c} double" for c in names)).repartition(5)
    points, load = library.library_map(df, "complex_id", {"G": names[:3], "D": names[3:]})
    m = np.array([[np.nan if v is None else v for v in r[1:]] for r in rows], float)
    mid, iqr = np.nanmedian(m, 0), np.nanpercentile(m, 75, 0) - np.nanpercentile(m, 25, 0)
    z = np.nan_to_num((m - mid) / iqr)
    z = z - z.mean(0)
    parts = []
    for b in (z[:, :3], z[:, 3:]):  # one component stands above noise in each
        u, s, _ = np.linalg.svd(b, full_matrices=False)
        parts.append(u[:, :1])
    u, s, _ = np.linalg.svd(np.concatenate(parts, 1), full_matrices=False)
    want = u[:, :2] * s[:2]
    got = np.array([[r["pc1"], r["pc2"]] for r in sorted(points.collect())])
    for k in range(2):
        corr = np.array([np.corrcoef(z[:, j], want[:, k])[0, 1] for j in range(7)])
        sign = np.sign(corr[np.abs(corr).argmax()])
        assert got[:, k] == pytest.approx(want[:, k] * sign, abs=1e-6)
        assert [r[f"pc{k + 1}"] for r in sorted(load.collect(), key=lambda r: names.index(r["feature"]))] == pytest.approx(corr * sign, abs=1e-6)


def test_permuted_spectra(spark):
    """The permutations are ones, and the spectra are those of the permuted columns."""
    keys = np.random.default_rng(7).integers(0, 1 << 63, (9, 5))
    for n in (1, 2, 3, 7, 64, 230):
        to = library.places(np.arange(n), n, keys)
        assert (np.sort(to, axis=2) == np.arange(n)).all()
    assert abs(np.corrcoef(to[0, 0], np.arange(230))[0, 1]) < 0.25 and (to[0] != to[1]).any()
    rng = np.random.default_rng(15)
    x = rng.normal(size=(230, 5)) + rng.normal(size=(230, 1)) * [3, 3, 3, 0, 0]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "k int, v array<double>").repartition(4)
    spans = [slice(0, 3), slice(3, 5)]
    null = library.permuted_spectra(df, "v", spans, draws=400, range_bytes=400 * 5 * 8 * 50)
    assert null.shape == (400, 5)
    free = np.array([np.concatenate([np.linalg.eigvalsh(np.cov(np.stack([rng.permutation(c) for c in x.T[s]]), bias=True))[::-1] for s in spans]) for _ in range(400)])
    assert null.mean(0) == pytest.approx(free.mean(0), rel=0.04) and null.std(0) == pytest.approx(free.std(0), rel=0.25)
    for s in spans:  # permuting a column leaves its variance
        assert null[:, s].sum(1) == pytest.approx(np.full(400, x[:, s].var(0).sum()), rel=1e-9)
    cov = np.cov(x.T, bias=True)
    assert library.noise_rank(cov[:3, :3], null[:, :3]) == 1 and library.noise_rank(cov[3:, 3:], null[:, 3:]) == 1
    assert library.permuted_spectra(df.where("k < 0"), "v", spans, draws=3).tolist() == [[0.0] * 5] * 3


def test_permuted_spectra_move_each_value_once(spark, monkeypatch):
    """However many draws, a value goes to one place."""
    asked = []
    monkeypatch.setattr(library, "places", lambda i, n, keys, f=library.places: asked.append(np.shape(keys)) or f(i, n, keys))
    df = spark.createDataFrame([(RNG.normal(size=4).tolist(),) for _ in range(300)], "v array<double>").repartition(3)

    def here(self, f, schema):  # the same function, in this process
        t = self.toArrow()
        out = [r for b in t.to_batches() for r in f(iter([b]))]
        rows = [r for b in out for r in b.to_pylist()]
        sent.append(sum(len(r["value"]) for r in rows))
        return spark.createDataFrame([tuple(r.values()) for r in rows], schema)

    sent = []
    monkeypatch.setattr(type(df), "mapInArrow", here)
    null = library.permuted_spectra(df, "v", [slice(0, 4)], draws=20, range_bytes=20 * 4 * 8 * 60)
    assert null.shape == (20, 4) and sent == [300 * 4] and set(asked) == {(4,)}
    assert len(np.unique(null[:, 0])) == 20


def test_basin_distances(spark):
    rows, x = [], {}
    for c, runs in (("p", (2, 3, 1)), ("single", (2,)), ("odd", (1, 1))):
        for r, n in enumerate(runs):
            for b in range(n):
                x[c, r, b] = RNG.normal(size=((5 if c != "odd" or r else 4), 3))
                rows.append((c, f"run{r}", b, 0.1 * (b + 1), x[c, r, b].ravel().tolist()))
    df = spark.createDataFrame(rows, "complex_id string, run string, basin int, population double, xyz array<double>")
    got = {r["complex_id"]: r for r in library.basin_distances(df, "complex_id").collect()}
    assert set(got) == {"p", "odd"} and got["odd"]["ok"] is False and got["odd"]["near_max"] is None
    ids = [k for k in x if k[0] == "p"]
    d = {(a, b): kabsch(x[a], x[b]) for a in ids for b in ids if a != b}
    own = [min(v) for a in ids if (v := [d[a, b] for b in ids if b != a and b[1] == a[1]])]
    cross = [min(d[a, b] for b in ids if b[1] != a[1]) for a in ids]
    w = [0.1 * (a[2] + 1) for a in ids]
    hit = sum(min((d[a, b], b) for b in ids if b != a)[1][1] != a[1] for a in ids)
    want = {
        "n_rep": 3, "n_basins": 6, "ok": True, "d_self": np.median(own), "d_cross": np.median(cross), "near_w": np.dot(cross, w) / sum(w), "near_max": max(cross), "hit": hit,
        "expected": sum(sum(b[1] != a[1] for b in ids) / 5 for a in ids), "within_pair": np.median([d[a, b] for a in ids for b in ids if a < b and a[1] == b[1]]),
    }
    assert {k: got["p"][k] for k in want} == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}


def plain_alignment(q, t):
    """Best (score, equal places, places without a gap) by recursion over states, one cell at a time."""
    from functools import lru_cache

    @lru_cache(None)
    def best(i, j, state):  # state: 0 both, 1 gap in t, 2 gap in q; of q[:i], t[:j] ending in it
        none = (-1e9, 0, 0)
        if i == 0 and j == 0:
            return (0, 0, 0) if state == 0 else none
        if state == 0:
            if not i or not j:
                return none
            s, e, c = max(best(i - 1, j - 1, k) for k in range(3))
            same = q[i - 1] == t[j - 1]
            return s + (2 if same else -1), e + same, c + 1
        a, b = (i - 1, j) if state == 1 else (i, j - 1)
        if a < 0 or b < 0:
            return none
        opened = [best(a, b, k) for k in range(3) if k != state]
        return max([(s - 6, e, c) for s, e, c in opened] + [(s - 1, e, c) for s, e, c in [best(a, b, state)]])

    return max(best(len(q), len(t), k) for k in range(3))


def test_alignments_and_best_matches(spark):
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("ACDEFG"), n))
    base = [word(n) for n in (12, 20, 9)]
    seqs = base + [b[:k] + b[k + 2 :] for b in base for k in (2, 5)] + [b[:4] + "WW" + b[4:] for b in base] + ["A", word(30)]
    pairs = [(a, b) for a in seqs for b in seqs]
    pairs += [("", ""), ("", "ACD"), ("ACD", ""), ("AĀ", "ĀA")]
    for cells in (1, 100_000):
        got = alignment.align_pairs([a for a, _ in pairs], [b for _, b in pairs], 2.0, -1.0, -6.0, -1.0, cells)
        assert got.tolist() == [list(map(float, plain_alignment(a, b))) for a, b in pairs]
    refs = [(f"R*{i % 17}", "R", s) for i, s in enumerate([*seqs, *base, "ACDEF"])] + [("N*1", "N", None), ("R*0", "R", base[0])]
    queries = [(1, base[0]), (2, base[1][:6] + base[1][8:]), (3, base[0]), (4, "YYYYYY"), (5, base[2][:-1] + "Y"), (6, None), (7, ""), (1, base[0])]
    want = []
    for key, q in queries:
        if q is not None:
            rows = []
            for allele, _, t in set(refs):
                if t is not None:
                    s, e, c = plain_alignment(q, t)
                    rows.append((-(e / c if c else 0.0), -float(bool(q)), -float(s), allele))
            want += [(key, a, i, c, s) for i, c, s, a in sorted(rows)[:3]]
    refs_df = spark.createDataFrame(refs, "allele string, locus string, sequence string")
    for options in ({}, {"block_letters": 60}, {"block_letters": 60, "most_broadcast": 0}):
        out = library.best_matches(spark.createDataFrame([q for q in queries[:7]], "query_id long, sequence string"), refs_df, **options)
        got = sorted((r["query_id"], r["rank"], r["allele"], -r["identity"], -r["coverage"], -r["score"]) for r in out.collect())
        assert [(k, a, *map(pytest.approx, (i, c, s))) for k, _, a, i, c, s in got] == sorted(want[:-3], key=lambda r: r[0])


def test_long_sequences_align():
    """More than 4095 places, in a second or so a pair; the counts don't run into each other."""
    rng = np.random.default_rng(8)
    a = "".join(rng.choice(list("ACDEFGHIKL"), 5000))
    b = a[:1000] + a[1010:3000] + "W" + a[3001:]
    assert alignment.align_pairs([a], [b], 2.0, -1.0, -6.0, -1.0).tolist() == [[2 * 4989 - 1 - 15, 4989, 4990]]


def test_two_sample_tests_and_intervals(spark):
    a, b = np.round(RNG.normal(size=60), 1), np.round(RNG.normal(size=45) + 0.4, 1)
    rows = [("g", float(v), True) for v in a] + [("g", float(v), False) for v in b] + [("h", 1.0, True), ("h", 1.0, True), ("h", 1.0, False), ("h", None, False)]
    df = spark.createDataFrame(rows, "grp string, v double, first boolean").repartition(5)
    got = {r["grp"]: r for r in profiles.two_sample_tests(df, "v", F.col("first"), "grp").collect()}
    every = np.concatenate([a, b])
    rank = np.array([(every < x).sum() + ((every == x).sum() + 1) / 2 for x in every])
    u = rank[:60].sum() - 60 * 61 / 2
    ties = sum(c**3 - c for c in np.unique(every, return_counts=True)[1])
    n = len(every)
    z = (abs(u - 60 * 45 / 2) - 0.5) / math.sqrt(60 * 45 / 12 * (n + 1 - ties / (n * (n - 1))))
    assert got["g"]["u"] == u and got["g"]["u_p"] == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-9)
    se = a.var(ddof=1) / 60, b.var(ddof=1) / 45
    t, k = (a.mean() - b.mean()) / math.sqrt(sum(se)), sum(se) ** 2 / (se[0] ** 2 / 59 + se[1] ** 2 / 44)
    x = np.linspace(math.atan(abs(t) / math.sqrt(k)), math.pi / 2, 200_001)
    p = 2 * np.trapezoid(np.cos(x) ** (k - 1), x) * math.exp(math.lgamma((k + 1) / 2) - math.lgamma(k / 2)) / math.sqrt(math.pi)
    assert got["g"]["welch_p"] == pytest.approx(p, rel=1e-5) and got["h"]["u_p"] is None
    one, two = (sorted(profiles.bootstrap_mean(df.repartition(m), "v", "grp").collect()) for m in (1, 6))
    assert [(r["grp"], r["mean"]) for r in one] == [("g", pytest.approx(every.mean())), ("h", 1.0)]
    assert [tuple(r) for r in one] == [(r["grp"], pytest.approx(r["mean"]), pytest.approx(r["low"]), pytest.approx(r["high"])) for r in two]
    spread = 1.96 * every.std() / math.sqrt(n)
    assert (one[0]["low"], one[0]["high"]) == (pytest.approx(every.mean() - spread, abs=0.25 * spread), pytest.approx(every.mean() + spread, abs=0.25 * spread))


def shapiro(x):
    """W and p from the ordered sample itself."""
    from statistics import NormalDist

    x, n = np.sort(np.asarray(x, float)), len(x)
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u, c = n**-0.5, m / math.sqrt((m * m).sum())
    a = m.copy()
    a[-1] = c[-1] + 0.221157 * u - 0.147981 * u**2 - 2.071190 * u**3 + 4.434685 * u**4 - 2.706056 * u**5
    a[-2] = c[-2] + 0.042981 * u - 0.293762 * u**2 - 1.752461 * u**3 + 5.682633 * u**4 - 3.582633 * u**5
    phi = ((m * m).sum() - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * a[-1] ** 2 - 2 * a[-2] ** 2)
    a[2:-2] = m[2:-2] / math.sqrt(phi)
    a[0], a[1] = -a[-1], -a[-2]
    w = (a @ x) ** 2 / ((x - x.mean()) ** 2).sum()
    y = math.log(n)
    z = (math.log(1 - w) - (0.0038915 * y**3 - 0.083751 * y**2 - 0.31082 * y - 1.5861)) / math.exp(0.0030302 * y**2 - 0.082676 * y - 0.4803)
    return w, 0.5 * math.erfc(z / math.sqrt(2))


def test_tie_ranks(spark):
    rng = np.random.default_rng(5)
    rows = [(None if k == 2 else str(k), float(v), int(v) % 2) for k in range(3) for v in np.append(rng.integers(0, 40, 150), np.full(100, 17))]
    df = spark.createDataFrame(rows, "k string, v double, odd int").repartition(7)
    got = {(r["k"], r["v"]): (r["n"], r["before"], r["total"], r["odd"]) for r in summaries.tie_ranks(df, "v", ["k"], {"odd": F.col("odd")}).collect()}
    want = {}
    for k in (None, "0", "1"):
        x = np.array([v for a, v, _ in rows if a == k])
        want |= {(k, v): (int((x == v).sum()), int((x < v).sum()), len(x), int((x == v).sum() * (v % 2))) for v in x.tolist()}
    assert got == want


def test_normality_and_choice_of_test(spark):
    rng = np.random.default_rng(17)
    groups = {f"n{k}": rng.normal(3, 2, 60) for k in range(200)} | {"ties": np.round(rng.normal(size=400), 1), "skew": rng.exponential(size=80), "small": rng.normal(size=11), "flat": np.full(30, 2.0), "big": rng.normal(size=3000)}
    df = spark.createDataFrame([(k, float(v)) for k, x in groups.items() for v in x] + [("n0", None)], "k string, v double").repartition(6)
    got = {r["k"]: (r["n"], r["w"], r["p"]) for r in profiles.normality(df, "v", "k").collect()}
    assert set(groups) - set(got) == {"small", "flat"}
    for k in got:
        w, p = shapiro(groups[k])
        assert got[k] == (len(groups[k]), pytest.approx(w, abs=1e-10), pytest.approx(p, abs=1e-7)), k
    below = np.mean([got[f"n{k}"][2] < 0.25 for k in range(200)])  # p-values of normal samples are even
    assert 0.15 < below < 0.35 and got["skew"][2] < 1e-6

    pairs = {"both": (rng.normal(size=70), rng.normal(1, 2, 55)), "skewed": (rng.normal(size=70), rng.exponential(size=90)), "few": (rng.normal(size=49), rng.normal(size=60)), None: (rng.normal(size=50), rng.normal(size=50))}
    rows = [(k, float(v), side) for k, xs in pairs.items() for side, x in zip((True, False), xs) for v in x] + [("both", 1.0, None)]
    chosen = {r["k"]: r for r in profiles.compare_samples(spark.createDataFrame(rows, "k string, v double, f boolean"), "v", F.col("f"), "k").collect()}
    for k, (a, b) in pairs.items():
        normal = len(a) >= 50 and len(b) >= 50 and shapiro(a)[1] > 0.05 and shapiro(b)[1] > 0.05
        assert chosen[k]["test"] == ("ttest" if normal else "wilcoxon"), k
        assert chosen[k]["p_value"] == chosen[k]["welch_p" if normal else "u_p"] and chosen[k]["significant"] == (chosen[k]["p_value"] < 0.05)
    assert chosen["both"]["test"] == "ttest" and chosen["skewed"]["test"] == chosen["few"]["test"] == "wilcoxon"


def test_smoothed_grid(spark):
    rng = np.random.default_rng(6)
    grids = {"a": rng.normal(size=(10, 13)), "b": rng.normal(size=(3, 5))}
    df = spark.createDataFrame([(k, i, j, float(g[i, j])) for k, g in grids.items() for i in range(g.shape[0]) for j in range(g.shape[1])], "traj_id string, ix int, iy int, g double")
    for sigma in (0.7, 2.0):
        half = int(4 * sigma + 0.5)
        w = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
        w /= w.sum()
        got = {(r["traj_id"], r["ix"], r["iy"]): r["g"] for r in landscape.smoothed(df, sigma).collect()}
        for k, g in grids.items():
            for axis in (0, 1):
                tiled = np.concatenate([np.flip(g, axis), g] * (half + 2), axis)  # mirrored again and again
                n, at = g.shape[axis], g.shape[axis] * (2 * ((half + 2) // 2) + 1)
                g = sum(w[o + half] * np.take(tiled, range(at + o, at + o + n), axis) for o in range(-half, half + 1))
            g = g - g.min()
            assert all(got[k, i, j] == pytest.approx(g[i, j], abs=1e-9) for i in range(g.shape[0]) for j in range(g.shape[1]))


def test_grids_of_all_replica_pairs(spark):
    rng = np.random.default_rng(3)
    p = {t: rng.random((4, 5)) * (rng.random((4, 5)) < 0.5) for t in "abcd"}
    p["d"][:] = 0
    p["d"][3, 4] = 1.0
    p = {t: x / x.sum() for t, x in p.items()}
    rows = [("x" if t in "abd" else "y", t, i, j, float(x[i, j]), float(-math.log(x[i, j]))) for t, x in p.items() for i in range(4) for j in range(5) if x[i, j] > 0]
    df = spark.createDataFrame(rows, "complex_id string, traj_id string, ix int, iy int, p double, g double").repartition(3)
    got = {(r["first"], r["second"]): (r["overlap"], r["kl_ab"], r["kl_ba"]) for r in landscape.compare_grids(df, "complex_id").collect()}
    near = {(r["first"], r["second"]): (r["jaccard"], r["n_union"]) for r in landscape.region_jaccard(df, 2.5, "complex_id").collect()}
    assert set(got) == set(near) == {("a", "b"), ("a", "d"), ("b", "d")}
    for a, b in got:
        x, y = np.maximum(p[a], 1e-10), np.maximum(p[b], 1e-10)
        held = (p[a] > 0) | (p[b] > 0)
        kl = lambda u, v: float((u * np.log(u / v))[held].sum())
        assert got[a, b] == pytest.approx((np.minimum(p[a], p[b]).sum(), kl(x, y), kl(y, x)), abs=1e-9)
        with np.errstate(divide="ignore"):
            low = [-np.log(p[t]) <= 2.5 for t in (a, b)]
        assert near[a, b] == (pytest.approx((low[0] & low[1]).sum() / (low[0] | low[1]).sum()), (low[0] | low[1]).sum())


def test_stacked_rings_and_cations_by_brute_force(spark):
    """Pairs by loops over rings: planes by singular values, angles and distances one by one."""
    rng = np.random.default_rng(13)
    points, rings, cations = [], {}, {}
    for f in range(12):
        for res in range(7):
            centre, (u, v) = rng.uniform(0, 9, 3), np.linalg.qr(rng.normal(size=(3, 2)))[0].T
            n = 4 if res == 6 else 6  # too few for a ring
            atoms = [centre + 1.4 * (math.cos(k) * u + math.sin(k) * v) + rng.normal(size=3) * 0.01 for k in np.arange(n) * 2 * math.pi / n]
            chain = "AB"[res % 2]
            points += [("t", f, chain, res, *map(float, a)) for a in atoms]
            if n >= 5:
                m = np.mean(atoms, axis=0)
                rings[f, chain, res] = m, np.linalg.svd(np.array(atoms) - m)[2][2]
        for res in (1, 20, 21, 22):
            cations[f, "B", res] = rng.uniform(0, 9, 3)
    pts = spark.createDataFrame(points, "traj_id string, frame int, chain_id string, resid int, x double, y double, z double").repartition(4)
    cat = spark.createDataFrame([("t", f, c, r, *map(float, x)) for (f, c, r), x in cations.items()], "traj_id string, frame int, chain_id string, resid int, x double, y double, z double")
    totals = spark.createDataFrame([("t", 12)], "traj_id string, total_frames long")
    planes = rings_of(pts)

    def events(first, second, hit):
        out = {}
        for (f, c, r), one in first.items():
            for (g, e, s), two in second.items():
                if f == g and hit((c, r), one, (e, s), two) is not None:
                    d = hit((c, r), one, (e, s), two)
                    n, least = out.get((c, r, e, s), (0, 1e9))
                    out[c, r, e, s] = n + 1, min(least, d)
        return out

    def stacked(a, one, b, two):
        d = np.linalg.norm(one[0] - two[0])
        angle = math.degrees(math.acos(min(1.0, abs(one[1] @ two[1]))))
        return d if a[0] == "A" and b[0] == "B" and d <= 6.5 and (angle <= 30 or 60 <= angle <= 120) else None

    def near_cation(a, one, b, two):
        v = one - two[0]
        d = np.linalg.norm(v)
        return d if a != b and d <= 6 and math.degrees(math.acos(min(1.0, abs(v @ two[1]) / d))) <= 60 else None

    shown = lambda df: {(r["chain_id_1"], r["resid_1"], r["chain_id_2"], r["resid_2"]): (r["contact_frames"], pytest.approx(r["min_distance"])) for r in df.collect()}
    want = events(rings, rings, stacked)
    assert len(want) > 5 and shown(stacked_of(planes, totals)) == want
    want = events(cations, rings, near_cation)
    assert len(want) > 5 and shown(cations_of(cat, planes, totals)) == want


def rings_of(points):
    return rings.ring_planes(points)


def stacked_of(planes, totals):
    return rings.stacked_rings(planes, F.col("chain_id") == "A", F.col("chain_id") == "B", totals)


def cations_of(cations, planes, totals):
    return rings.cation_rings(cations, planes, totals)
