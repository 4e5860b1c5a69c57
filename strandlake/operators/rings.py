"""Ring planes and the interactions that depend on them; surfaces, bulges, basins and contact-network communities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.kernels import graph
from strandlake.operators.contacts import capped_pairs, pair_table
from strandlake.operators.geometry import per_frame

RING = ("traj_id", "frame", "chain_id", "resid")


def ring_planes(points: DataFrame, least: int = 5) -> DataFrame:
    """Centroid and unit normal of each ring (the rows of one residue): moments are Spark sums, the normal is the smallest axis of the 3x3 matrix."""
    pairs = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    m = points.groupBy(*RING).agg(F.count("*").alias("n"), *(F.avg(a).alias(a) for a in "xyz"), *(F.covar_pop(a, b).alias(a + b) for a, b in pairs)).where(F.col("n") >= least)
    names = [*RING, "x", "y", "z", "nx", "ny", "nz"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {a + q: b[a + q].to_numpy(zero_copy_only=False) for a, q in pairs}
            full = np.array([[c["".join(sorted(a + q))] for q in "xyz"] for a in "xyz"]).transpose(2, 0, 1)
            normal = np.linalg.eigh(full)[1][:, :, 0] if b.num_rows else np.empty((0, 3))
            yield pa.RecordBatch.from_arrays([*(b[k] for k in names[:7]), *(pa.array(normal[:, k]) for k in range(3))], names)

    return m.mapInArrow(run, "traj_id string, frame int, chain_id string, resid int, x double, y double, z double, nx double, ny double, nz double")


def _angle(cos: Column) -> Column:
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))


def stacked_rings(rings: DataFrame, side_1: Column, side_2: Column, totals: DataFrame, reach: float = 6.5, flat: float = 30.0, tee: tuple[float, float] = (60.0, 120.0)) -> DataFrame:
    """Pairs of rings whose centroids are near and whose planes are parallel (up to ``flat`` degrees) or across (within ``tee``)."""
    near = capped_pairs(rings.where(side_1), rings.where(side_2), reach)
    angle = _angle(F.abs(sum((F.col(f"n{a}_1") * F.col(f"n{a}_2") for a in "xyz"), F.lit(0.0))))
    return pair_table(near.withColumn("angle", angle).where((F.col("angle") <= flat) | F.col("angle").between(*tee)), totals, "pi_pi")


def cation_rings(cations: DataFrame, rings: DataFrame, totals: DataFrame, reach: float = 6.0, most: float = 60.0) -> DataFrame:
    """Charged centres (traj_id, frame, chain_id, resid, x, y, z) near a ring's centroid of another residue, within ``most`` degrees of its normal."""
    near = capped_pairs(cations, rings, reach).where("chain_id_1 <> chain_id_2 OR resid_1 <> resid_2")
    v = {a: F.col(f"{a}_1") - F.col(f"{a}_2") for a in "xyz"}
    cos = F.abs(sum((v[a] * F.col(f"n{a}_2") for a in "xyz"), F.lit(0.0))) / F.nullif(F.col("distance"), F.lit(0.0))
    return pair_table(near.where(_angle(cos) <= most), totals, "cation_pi")


def peptide_bulge(frames: DataFrame, platform: list[int], peptide: list[int]) -> DataFrame:
    """Largest height of the peptide's atoms over the plane fitted to the platform, per frame."""

    def kernel(x: np.ndarray, ref: np.ndarray) -> dict[str, np.ndarray]:
        g = x[:, platform]
        c = g.mean(1, keepdims=True)
        normal = np.linalg.svd(g - c)[2][:, 2]
        return {"bulge": np.abs(np.einsum("fni,fi->fn", x[:, peptide] - c, normal)).max(1)}

    return per_frame(frames, kernel, "bulge double")


def surface_areas(frames: DataFrame, radius: list[float], sides: dict[str, list[int]], probe: float = 1.4) -> DataFrame:
    """Accessible surface of each set of atoms, alone and within the whole, per frame; frames stay where they are read."""
    r = np.array(radius)
    names = [f"{n}_{k}" for n in sides for k in ("alone", "bound")]

    def kernel(x: np.ndarray, ref: np.ndarray) -> dict[str, np.ndarray]:
        out = {n: np.empty(len(x)) for n in names}
        for f in range(len(x)):
            whole = graph.accessible_area(x[f], r, probe)
            for n, at in sides.items():
                out[f"{n}_alone"][f] = graph.accessible_area(x[f][at], r[at], probe).sum()
                out[f"{n}_bound"][f] = whole[at].sum()
        return out

    return per_frame(frames, kernel, ", ".join(f"{n} double" for n in names))


def energy_basins(grid: DataFrame, limit: float, least: int = 5) -> DataFrame:
    """4-connected regions of cells up to ``limit`` with at least ``least`` cells, by depth. One trajectory's grid a task."""

    def run(t: pa.Table) -> pa.Table:
        ix, iy, g, n = (t[c].to_numpy() for c in ("ix", "iy", "g", "n"))
        e, count = np.full((ix.max() + 1, iy.max() + 1), np.inf), np.zeros((ix.max() + 1, iy.max() + 1))
        e[ix, iy], count[ix, iy] = g, n
        label = graph.labelled_regions(e <= limit, least)
        rows = []
        for k in range(1, label.max() + 1):
            inside = label == k
            a, b = np.unravel_index(np.where(inside, e, np.inf).argmin(), e.shape)
            rows.append((float(e[a, b]), int(a), int(b), int(inside.sum()), float(count[inside].sum() / max(count.sum(), 1))))
        rows.sort()
        cols = ("depth", "ix", "iy", "n_cells", "population")
        kinds = (pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
        data = {c: pa.array([r[i] for r in rows], k) for i, (c, k) in enumerate(zip(cols, kinds))}
        return pa.table({"traj_id": pa.array([t["traj_id"][0].as_py()] * len(rows), pa.string()), "basin": pa.array(range(len(rows)), pa.int32()), **data})

    return grid.groupBy("traj_id").applyInArrow(run, "traj_id string, basin int, depth double, ix int, iy int, n_cells int, population double")


def network_communities(edges: DataFrame, seed: int = 42) -> DataFrame:
    """(traj_id, node, community, betweenness, modularity) of edges (traj_id, i, j, weight, length). One trajectory's network a task."""

    def run(t: pa.Table) -> pa.Table:
        i, j = t["i"].to_pylist(), t["j"].to_pylist()
        nodes = sorted({*i, *j})
        weighted = list(zip(i, j, t["weight"].to_pylist()))
        label = graph.communities(nodes, weighted, seed)
        between = graph.betweenness(nodes, list(zip(i, j, t["length"].to_pylist())))
        q = graph.modularity(weighted, label)
        return pa.table(
            {
                "traj_id": pa.array([t["traj_id"][0].as_py()] * len(nodes), pa.string()),
                "node": pa.array(nodes, pa.int32()),
                "community": pa.array([label[n] for n in nodes], pa.int32()),
                "betweenness": pa.array([between[n] for n in nodes], pa.float64()),
                "modularity": pa.array([q] * len(nodes), pa.float64()),
            }
        )

    return edges.groupBy("traj_id").applyInArrow(run, "traj_id string, node int, community int, betweenness double, modularity double")
