"""Series in chunks: the same rows whatever the length of a chunk, against plain loops over the whole series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import annotate, chunks, persistence, series

RNG = np.random.default_rng(5)
#: frames with holes wider than a chunk, one that fills a chunk exactly, and one sample
FRAMES = {"gaps": np.sort(RNG.choice(3000, 700, replace=False)), "whole": np.arange(400), "far": np.concatenate([np.arange(60), np.arange(5000, 5090)]), "one": np.array([7])}
VALUES = {t: np.where(np.arange(len(f)) < len(f) // 3, RNG.normal(size=len(f)) * 5, RNG.normal(size=len(f)) * 0.2) + 50 for t, f in FRAMES.items()}
SPANS = [100, 7, chunks.SPAN]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(t, int(f), float(f) * 2, float(v)) for t in FRAMES for f, v in zip(FRAMES[t], VALUES[t])]
    RNG.shuffle(rows := np.array(rows, object))
    return spark.createDataFrame([(r[0], int(r[1]), float(r[2]), float(r[3])) for r in rows], "traj_id string, frame int, time_s double, value double").repartition(5)


@pytest.mark.parametrize("span", SPANS)
def test_places(table, span):
    got = {(r["traj_id"], r["frame"]): (r["i"], r["n"], r["mean"]) for r in chunks.numbered(table, "traj_id", "frame", mean="value", span=span).collect()}
    assert len(got) == sum(map(len, FRAMES.values()))
    for t, f in FRAMES.items():
        for i, x in enumerate(f):
            assert got[t, x][:2] == (i, len(f)) and got[t, x][2] == pytest.approx(VALUES[t].mean())


@pytest.mark.parametrize("ahead", [False, True])
@pytest.mark.parametrize("span", SPANS)
def test_running(table, span, ahead):
    out = chunks.cut(table, "frame", span)
    for name, how in (("s", F.sum), ("lo", F.min), ("hi", F.max)):
        out = chunks.running(out, "traj_id", "frame", {name: F.col("value")}, how, ahead)
    got = {(r["traj_id"], r["frame"]): r for r in out.collect()}
    for t, f in FRAMES.items():
        for i, x in enumerate(f):
            seen = VALUES[t][i:] if ahead else VALUES[t][: i + 1]
            r = got[t, x]
            assert (r["s"], r["lo"], r["hi"]) == (pytest.approx(seen.sum()), seen.min(), seen.max())


@pytest.mark.parametrize("width", [1, 10, 250])
@pytest.mark.parametrize("span", [100, 7])
def test_moving_average(table, span, width):
    got = {(r["traj_id"], r["frame"]): r["moving"] for r in series.moving_average(table, width, span).collect()}
    assert len(got) == sum(max(0, len(f) - width + 1) for f in FRAMES.values())
    for t, f in FRAMES.items():
        for i in range(width - 1, len(f)):
            assert got[t, f[i]] == pytest.approx(VALUES[t][i - width + 1 : i + 1].mean())


@pytest.mark.parametrize("span", SPANS)
def test_convergence_point(table, span):
    got = {r["traj_id"]: (r["index"], r["time"]) for r in series.convergence_point(table, 10, 0.3, span).collect()}
    assert set(got) == set(FRAMES)
    for t, f in FRAMES.items():
        m = np.array([VALUES[t][i - 9 : i + 1].mean() for i in range(9, len(f))])
        w = max(10, len(m) // 10)
        ok = np.array([m[max(0, j - w) : j + 1].std() < 0.3 for j in range(len(m))])
        hits = [j for j in range(len(m)) if len(m) >= 20 and ok[j] and len(m) - j > 0.2 * len(m) and ok[j:].mean() > 0.8]
        assert got[t] == ((hits[0], f[hits[0] + 9] * 2.0) if hits else (None, None))
    assert got["gaps"][0] and got["whole"][0] and got["one"] == (None, None)


@pytest.mark.parametrize("span", SPANS)
def test_convergence_time(table, span):
    got = {r["traj_id"]: r["time"] for r in series.convergence_time(table, 40, span=span).collect()}
    for t, v in VALUES.items():
        n = len(v)
        if n < 40:
            assert got[t] is None
            continue
        w, hold = max(40, n // 20), max(40, n // 10)
        dev = np.array([v[max(0, i - w) : min(n, i + w)].std() for i in range(n)])
        limit = 1.2 * dev[int(n * 0.8) :].mean()
        first = next((i for i in range(w, n - w) if (dev[i : i + hold] <= limit).all()), None)
        assert got[t] == pytest.approx(n * 0.4 if first is None else first * 2.0)


@pytest.mark.parametrize("span", SPANS)
def test_dwells(table, span):
    states = table.select("traj_id", "frame", (F.floor(F.col("value") / 4) % 3).alias("state"), F.col("time_s").alias("time_ps"))
    got = sorted((r["traj_id"], r["run"], r["state"], r["first"], r["last"], r["n"], round(r["duration"], 9)) for r in persistence.dwell_segments(states, span=span).collect())
    want = []
    for t, f in FRAMES.items():
        s = np.floor(VALUES[t] / 4).astype(int) % 3
        step = float(np.median(np.diff(f * 2.0))) if len(f) > 1 else 0.0
        cuts = [0, *(np.flatnonzero(np.diff(s)) + 1), len(s)]
        want += [(t, k, s[a], f[a], f[b - 1], b - a, round((f[b - 1] - f[a]) * 2.0 + step, 9)) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert got == sorted(want)


@pytest.mark.parametrize("span", [100, 7])
def test_lagged_and_downsampled(table, span):
    f = table.select("traj_id", "frame", F.posexplode(F.array("value", F.col("value") * F.col("value"))).alias("j", "x"))
    got = {(r["traj_id"], r["i"], r["j"]): (r["c00"], r["ctt"], r["c0t"]) for r in series.lagged_covariance(f, 12, span).collect()}
    thin = {(r["traj_id"], r["frame"]) for r in annotate.downsample(table, 20, span=span).collect()}
    assert thin == {(t, x) for t, g in FRAMES.items() for x in g[:: max(1, len(g) // 20)]}
    for t in ("gaps", "whole", "far"):
        x = np.stack([VALUES[t], VALUES[t] ** 2])
        c = np.cov(np.concatenate([x[:, :-12], x[:, 12:]]))
        for i in range(2):
            for j in range(2):
                np.testing.assert_allclose(got[t, i, j], (c[i, j], c[2 + i, 2 + j], c[i, 2 + j]), rtol=1e-7)


@pytest.mark.parametrize("span", [100])
def test_drift_table(table, span):
    got = {r["traj_id"]: r for r in series.drift_table(table, span=span).collect()}
    for t, v in VALUES.items():
        n = len(v)
        tail, last = v[round(0.1 * (n - 1)) :], slice(round(0.8 * (n - 1)), None)
        assert got[t]["tail_mean"] == pytest.approx(tail.mean())
        assert got[t]["tail_band"] == pytest.approx(np.percentile(tail, 95) - np.percentile(tail, 5))
        assert n == 1 or got[t]["slope"] == pytest.approx(np.polyfit(FRAMES[t][last] * 2.0, v[last], 1)[0], abs=1e-9)


@pytest.mark.parametrize("span", SPANS)
def test_nearest(spark, table, span):
    anchors = spark.createDataFrame([(t, x) for t in FRAMES for x in range(0, 5200, 97)], "traj_id string, frame int")
    got = {(r["traj_id"], r["frame"]): (r["value"], r["in_window"]) for r in series.nearest_window(anchors, table, 3, span=span).collect()}
    for (t, x), (value, inside) in got.items():
        gap = np.abs(FRAMES[t] - x)
        near = VALUES[t][gap <= 3]
        assert inside == bool(len(near)) and value == pytest.approx(near.mean() if len(near) else VALUES[t][gap.argmin()])
    assert len(got) == anchors.count()


def test_plan_has_no_window_over_a_series(table):
    """Rows are sorted by series and chunk; only chunk totals meet in a window over a series."""
    plan = chunks.numbered(table, "traj_id", "frame")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line]
    assert len(windows) == 3 or len(windows) == 2
    assert sum("row_number" in line for line in windows) == 1 and all("chunk" in line for line in windows if "row_number" in line)


def test_empty(spark, table):
    none = table.where("false")
    assert series.moving_average(none).count() == 0 and series.convergence_point(none).count() == 0 and series.convergence_time(none).count() == 0
    assert persistence.dwell_segments(none.select("traj_id", "frame", F.col("value").alias("state"), F.col("time_s").alias("time_ps"))).count() == 0
