"""The three workloads end to end: interface profiles, library statistics, state landscapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators import annotate, contacts, landscape, replicas, summaries


def interface_profile(points: DataFrame, side_1: Column, side_2: Column, chains: DataFrame, regions: DataFrame, cutoff: float = 4.5, stride: int = 1) -> DataFrame:
    """Contacts of every trajectory, their persistence, interaction class and stability: one row per residue pair.

    Shuffles: the distance join on (trajectory, frame, cell), the reduction to residues, and the reduction over frames."""
    pairs = contacts.contact_frequencies(points, side_1, side_2, cutoff, stride)
    semantics = annotate.residue_semantics(points.select("chain_id", "resid").distinct(), chains, regions)
    return summaries.pair_occupancy(annotate.annotate_pairs(pairs, semantics))


def library_statistics(replica_rows: DataFrame, value: str, labels: list[str], group: str, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """(one row per complex: mean, spread, reproducibility, the primary replica's labels; distribution of the means per group)."""
    rows = replicas.collapse(replica_rows, [value], labels)
    spread = replicas.replica_spread(replica_rows, value, tolerance).select("complex_id", "spread", "reproducible")
    complexes = rows.join(spread, "complex_id", "left")
    return complexes, replicas.distribution(complexes, value, group)


def state_landscape(points: DataFrame, x: str, y: str, n_states: int = 3) -> tuple[DataFrame, DataFrame]:
    """(free-energy grid of each trajectory, each frame's nearest of the ``n_states`` fullest cells)."""
    cells = landscape.histogram(points, x, y)
    top = summaries.top_k(cells, n_states, [F.desc("n"), "ix", "iy"], "traj_id", rank="state")
    ends = points.groupBy("traj_id").agg(F.min(x).alias("xl"), F.max(x).alias("xh"), F.min(y).alias("yl"), F.max(y).alias("yh"))
    middle = lambda lo, hi, i, n: F.col(lo) + (F.col(i) + 0.5) * (F.col(hi) - F.col(lo)) / F.col(n)
    centres = top.join(ends, "traj_id").select("traj_id", "state", middle("xl", "xh", "ix", "nx").alias(x), middle("yl", "yh", "iy", "ny").alias(y))
    return landscape.free_energy(cells), landscape.nearest_centre(points, centres, (x, y))
