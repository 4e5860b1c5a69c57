"""Queries whose last step is a numeric kernel."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake import adapters as ad
from strandlake.operators import contacts, dynamics, landscape, rings
from strandlake.queries.base import Registry
from strandlake.queries.motion_queries import dense
from strandlake.queries.series_queries import cvs

R = Registry()


def planes(spark, d):
    """Each chain of four atoms or more stands for a ring: residues of the views have two atoms at most."""
    return rings.ring_planes(ad.placed_atoms(spark, d).where("chain_id IN ('A', 'C', 'D', 'E')").withColumn("resid", F.lit(1)), 4)


def totals(spark, d):
    return ad.frames(spark, d).groupBy("traj_id").agg(F.count("*").alias("total_frames"))


@R.add("c05_ring_centroids", "placed", "SELECT traj_id, frame, chain_id, avg(x) x, avg(y) y, avg(z) z FROM placed WHERE chain_id IN ('A','C','D','E') GROUP BY ALL", "x y z")
def _(spark, d):
    return planes(spark, d).drop("resid", "nx", "ny", "nz")


@R.add("c05_pi_stacking")
def _(spark, d):
    return rings.stacked_rings(planes(spark, d), F.col("chain_id").isin("A", "C"), F.col("chain_id").isin("D", "E"), totals(spark, d))


@R.add("c06_cation_pi")
def _(spark, d):
    cation = ad.placed_atoms(spark, d).where("resname IN ('LYS', 'ARG')").select("traj_id", "frame", "chain_id", "resid", "x", "y", "z")
    return rings.cation_rings(cation, planes(spark, d), totals(spark, d))


@R.add("m10_network_communities")
def _(spark, d):
    p = ad.frame_atoms(spark, d)
    v = dynamics.cross_correlation(dense(spark, d)).select("traj_id", "i", "j", "v")
    return rings.network_communities(contacts.persistent_network(p, v, share=0.5).where("i < j"))


@R.add("m19_energy_basins")
def _(spark, d):
    return rings.energy_basins(landscape.free_energy(landscape.histogram(cvs(spark, d), "cv1", "cv2")), 8.0, 3)


@R.add("m35_peptide_bulge")
def _(spark, d):
    return rings.peptide_bulge(dense(spark, d), list(range(7)), [9, 10, 11, 12])


@R.add("m36_surface_areas")
def _(spark, d):
    return rings.surface_areas(dense(spark, d), [1.7] * 21, {"phla": list(range(13)), "tcr": list(range(13, 21))})
