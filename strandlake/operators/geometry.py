"""Per-frame geometry: superposition, flexibility, distances, angles, docking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.functions.labels import acute_degrees, dihedral_degrees
from strandlake.kernels import linear

FRAME = ("traj_id", "frame")


def frames_as_arrays(points: DataFrame) -> DataFrame:
    """(traj_id, frame, xyz): 3N coordinates in atom order, for the dense kernels."""
    xyz = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("atom_id", "x", "y", "z"))), lambda s: F.array(s["x"], s["y"], s["z"])))
    return points.groupBy(*FRAME).agg(xyz.alias("xyz"))


def stack(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of 3N coordinate arrays as (F, N, 3)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1, 3)


def per_frame(frames: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], fields: str, reference: int = 0) -> DataFrame:
    """Apply ``kernel(frames, reference frame)`` to batches of frames; every row carries its trajectory's reference, so frames stay where
    they are read and no trajectory is gathered."""
    ref = frames.where(F.col("frame") == reference).select("traj_id", F.col("xyz").alias("ref"))
    names = [f.split()[0] for f in fields.split(",")]
    rows = frames.join(ref, "traj_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids = np.array(b["traj_id"].to_pylist(), object)
            out = {n: np.empty(b.num_rows) for n in names}
            for t in pd.unique(ids):
                at = np.flatnonzero(ids == t)
                part = b.take(pa.array(at))
                got = kernel(stack(part["xyz"]), stack(part["ref"].slice(0, 1))[0])
                for n in names:
                    out[n][at] = got[n]
            yield pa.RecordBatch.from_arrays([b["traj_id"], b["frame"], *(pa.array(out[n], from_pandas=True) for n in names)], ["traj_id", "frame", *names])

    return rows.select("traj_id", "frame", "xyz", "ref").mapInArrow(run, "traj_id string, frame int, " + fields)


def rmsd_series(frames: DataFrame, reference: int = 0) -> DataFrame:
    """RMSD of each frame to the reference frame after optimal superposition."""
    return per_frame(frames, lambda x, ref: {"rmsd": linear.fitted_rmsd(x, ref[None])[:, 0]}, "rmsd double", reference)


def region_rmsd(frames: DataFrame, anchor: list[int], regions: dict[str, list[int]], reference: int = 0) -> DataFrame:
    """RMSD of each region after superposing on the anchor atoms alone."""
    fit = np.array(anchor)

    def kernel(x: np.ndarray, ref: np.ndarray) -> dict[str, np.ndarray]:
        y = linear.superpose(x, ref, fit)
        return {n: linear.rmsd(y[:, i], ref[i]) for n, i in regions.items()}

    return per_frame(frames, kernel, ", ".join(f"{n} double" for n in regions), reference)


def docking(frames: DataFrame, platform: list[int], alpha: list[int], beta: list[int], peptide: list[int]) -> DataFrame:
    """Crossing and incident angles and polarity of each frame."""
    sets = [np.array(s) for s in (platform, alpha, beta, peptide)]

    def kernel(x: np.ndarray, ref: np.ndarray) -> dict[str, np.ndarray]:
        return dict(zip(("crossing", "incident", "polarity"), linear.docking_angles(x, *sets).T))

    return per_frame(frames, kernel, "crossing double, incident double, polarity double")


def reference_docking(frames: DataFrame, helix_1: list[int], helix_2: list[int], backbone: list[int], receptor: list[int], reference: int = 0) -> DataFrame:
    """Crossing and incident angles of each frame against the groove frame of the trajectory's reference frame."""
    sets = [np.array(s) for s in (helix_1, helix_2, backbone, receptor)]
    kernel = lambda x, ref: dict(zip(("crossing", "incident"), linear.reference_groove_angles(x, ref, *sets).T))
    return per_frame(frames, kernel, "crossing double, incident double", reference)


VIEW = (*(f"{n}_{a}" for n in ("up", "view", "centre") for a in "xyz"), "half_width", "half_height")


def view_axes(frames: DataFrame, chains: list[list[int]]) -> DataFrame:
    """Up and view directions, box centre and half sizes of each frame; the view looks so that the peptide runs to the right."""
    groups = [np.array(c) for c in chains]
    return per_frame(frames, lambda x, ref: dict(zip(VIEW, linear.view_frame(x, groups).T)), ", ".join(f"{n} double" for n in VIEW))


def rmsf(points: DataFrame) -> DataFrame:
    """Root mean square fluctuation of each atom about its mean position; no fit inside."""
    return points.groupBy("traj_id", "atom_id").agg(F.sqrt(F.var_pop("x") + F.var_pop("y") + F.var_pop("z")).alias("rmsf"))


def centre(side: Column, tag: str) -> list[Column]:
    m = F.when(side, F.col("mass"))
    return [(F.sum(m * F.col(a)) / F.sum(m)).alias(f"{a}_{tag}") for a in "xyz"]


def com_distance(points: DataFrame, side_1: Column, side_2: Column) -> DataFrame:
    """Distance of the centres of mass of two selections in each frame: both in one aggregation."""
    c = points.where(side_1 | side_2).groupBy(*FRAME).agg(*centre(side_1, "1"), *centre(side_2, "2"))
    return c.select(*FRAME, F.sqrt(sum(((F.col(f"{a}_1") - F.col(f"{a}_2")) ** 2 for a in "xyz"), F.lit(0.0))).alias("distance"))


def radius_of_gyration(points: DataFrame) -> DataFrame:
    """From moment sums: sqrt(sum(m r^2) / sum(m) - com^2)."""
    m = F.col("mass")
    second = sum((F.sum(m * F.col(a) * F.col(a)) / F.sum(m) for a in "xyz"), F.lit(0.0))
    first = sum(((F.sum(m * F.col(a)) / F.sum(m)) ** 2 for a in "xyz"), F.lit(0.0))
    return points.groupBy(*FRAME).agg(F.sqrt(F.greatest(F.lit(0.0), second - first)).alias("rg"))


def basic_geometry(points: DataFrame) -> DataFrame:
    """Centre of mass, box volume and the six moments of inertia about the centre, of each frame."""
    m = F.col("mass")
    total = F.sum(m)
    mean = {a: F.sum(m * F.col(a)) / total for a in "xyz"}
    cov = lambda a, b: F.sum(m * F.col(a) * F.col(b)) - total * mean[a] * mean[b]
    box = (F.max("x") - F.min("x")) * (F.max("y") - F.min("y")) * (F.max("z") - F.min("z"))
    return points.groupBy(*FRAME).agg(
        *(mean[a].alias(f"com_{a}") for a in "xyz"),
        box.alias("box_volume"),
        (cov("y", "y") + cov("z", "z")).alias("ixx"),
        (cov("x", "x") + cov("z", "z")).alias("iyy"),
        (cov("x", "x") + cov("y", "y")).alias("izz"),
        (-cov("x", "y")).alias("ixy"),
        (-cov("x", "z")).alias("ixz"),
        (-cov("y", "z")).alias("iyz"),
    )


def consecutive_geometry(points: DataFrame) -> DataFrame:
    """Distances between atoms next to each other in order, and angles at every inner one: mean, deviation, extremes per frame."""
    w = W.partitionBy(*FRAME).orderBy("atom_id")
    nxt = [F.lead(a, 1).over(w) - F.col(a) for a in "xyz"]
    p = points.withColumns({f"d{a}": d for a, d in zip("xyz", nxt)})
    p = p.withColumns({f"e{a}": F.lead(f"d{a}", 1).over(w) for a in "xyz"})
    dot = lambda u, v: sum((F.col(f"{u}{a}") * F.col(f"{v}{a}") for a in "xyz"), F.lit(0.0))
    length = F.sqrt(dot("d", "d"))
    cos = -dot("d", "e") / F.sqrt(dot("d", "d") * dot("e", "e"))
    q = p.select(*FRAME, length.alias("len"), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))).alias("ang"))
    stats = [f(c).alias(f"{c}_{n}") for c in ("len", "ang") for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    return q.groupBy(*FRAME).agg(*stats)


def dihedrals(points: DataFrame, quartets: DataFrame) -> DataFrame:
    """Torsions of named atom quartets (name, a, b, c, d), in degrees. One aggregation per frame and quartet instead of four joins."""
    long = quartets.select("name", F.posexplode(F.array("a", "b", "c", "d")).alias("k", "atom_id"))
    j = points.join(long, "atom_id")
    at = [[F.max(F.when(F.col("k") == k, F.col(a))).alias(f"{a}{k}") for a in "xyz"] for k in range(4)]
    flat = j.groupBy(*FRAME, "name").agg(*(c for row in at for c in row))
    return flat.select(*FRAME, "name", dihedral_degrees([[F.col(f"{a}{k}") for a in "xyz"] for k in range(4)]).alias("degrees"))


def axial_angle(points: DataFrame, axis_1: tuple[int, int], axis_2: tuple[int, int]) -> DataFrame:
    """The acute angle between two axes, each through two atoms."""
    ends = {"a": axis_1[0], "b": axis_1[1], "c": axis_2[0], "d": axis_2[1]}
    g = points.where(F.col("atom_id").isin(*ends.values())).groupBy(*FRAME).agg(*(F.max(F.when(F.col("atom_id") == i, F.col(a))).alias(f"{a}{n}") for n, i in ends.items() for a in "xyz"))
    u, v = [F.col(f"{a}b") - F.col(f"{a}a") for a in "xyz"], [F.col(f"{a}d") - F.col(f"{a}c") for a in "xyz"]
    dot = lambda p, q: p[0] * q[0] + p[1] * q[1] + p[2] * q[2]
    return g.select(*FRAME, acute_degrees(dot(u, v) / F.sqrt(dot(u, u) * dot(v, v))).alias("degrees"))


def centre_drift(points: DataFrame) -> DataFrame:
    """Largest distance of a frame's centre of mass to the trajectory's mean centre."""
    c = points.groupBy(*FRAME).agg(*((F.sum(F.col("mass") * F.col(a)) / F.sum("mass")).alias(a) for a in "xyz"))
    m = c.groupBy("traj_id").agg(*(F.avg(a).alias(f"m{a}") for a in "xyz"))
    d = F.sqrt(sum(((F.col(a) - F.col(f"m{a}")) ** 2 for a in "xyz"), F.lit(0.0)))
    return c.join(m, "traj_id").groupBy("traj_id").agg(F.max(d).alias("max_drift"))


def frame_integrity(frames: DataFrame, expected: int) -> DataFrame:
    return frames.groupBy("traj_id").agg(F.count("*").alias("n_frames"), F.count_if(F.size("xyz") <= 0).alias("n_empty")).withColumn("complete", (F.col("n_frames") == expected) & (F.col("n_empty") == 0))


def distance_trim(points: DataFrame, peptide: Column, cutoff: float) -> DataFrame:
    """Residues whose centre is within ``cutoff`` of the centre of the middle peptide residue (place n // 2), per frame; removed ones too."""
    res = points.withColumn("pep", peptide).groupBy(*FRAME, "chain_id", "resid").agg(*((F.sum(F.col("mass") * F.col(a)) / F.sum("mass")).alias(a) for a in "xyz"), F.bool_or("pep").alias("pep"))
    w = W.partitionBy(*FRAME).orderBy("chain_id", "resid")
    pep = res.where("pep").withColumns({"i": F.row_number().over(w) - 1, "n": F.count("*").over(W.partitionBy(*FRAME))}).where("i = n div 2")
    mid = pep.select(*FRAME, *(F.col(a).alias(f"m{a}") for a in "xyz"))
    d = F.sqrt(sum(((F.col(a) - F.col(f"m{a}")) ** 2 for a in "xyz"), F.lit(0.0)))
    return res.join(mid, list(FRAME)).withColumn("distance", d).select(*FRAME, "chain_id", "resid", "distance", (F.col("distance") <= cutoff).alias("kept"))


def loop_geometry(points: DataFrame, loop: Column, peptide: Column) -> DataFrame:
    """Span between a loop's first and last atom, and the distance of its tip (place n // 2) to the peptide's centre, per frame."""
    arr = F.array_sort(F.collect_list(F.when(loop, F.struct("atom_id", "x", "y", "z"))))
    g = points.where(loop | peptide).groupBy(*FRAME).agg(arr.alias("l"), *(F.avg(F.when(peptide, F.col(a))).alias(f"p{a}") for a in "xyz"))
    first, last, tip = F.element_at("l", 1), F.element_at("l", -1), F.col("l")[F.floor(F.size("l") / 2).cast("int")]
    gap = lambda u, v: F.sqrt(sum(((u(a) - v(a)) ** 2 for a in "xyz"), F.lit(0.0)))
    return g.select(*FRAME, gap(lambda a: last[a], lambda a: first[a]).alias("span"), gap(lambda a: tip[a], lambda a: F.col(f"p{a}")).alias("tip_distance"))
