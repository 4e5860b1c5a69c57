"""Joins that assemble features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def static_features(pairs: DataFrame, regions: DataFrame, hotspot: float) -> DataFrame:
    """Long features of a trajectory: occupancy summed by loop region, and one feature per pair of at least ``hotspot`` frequency."""
    g = regions.withColumnRenamed("chain_id", "_c")
    by = pairs.join(g, (F.col("chain_id_2") == F.col("_c")) & F.col("resid_2").between(F.col("resid_start"), F.col("resid_end")), "left")
    sums = by.groupBy("traj_id", F.coalesce("region", F.lit("none")).alias("feature")).agg(F.sum("contact_frequency").alias("value"))
    name = F.concat(F.lit("hot_"), "chain_id_1", F.col("resid_1").cast("string"), F.lit("_"), "chain_id_2", F.col("resid_2").cast("string"))
    hot = pairs.where(F.col("contact_frequency") >= hotspot).select("traj_id", name.alias("feature"), F.col("contact_frequency").alias("value"))
    return sums.unionByName(hot)


def widest_run_coupling(rows: DataFrame, key: str, run: str, widest: str, low: list[str], high: list[str]) -> DataFrame:
    """Whether the replica with the largest ``widest`` also has the least of each ``low`` and the largest of each ``high`` metric; complexes with three
    complete rows or more."""
    full = rows.dropna(subset=[widest, *low, *high])
    g = full.groupBy(key).agg(
        F.count("*").alias("n"),
        *(F.max_by(c, widest).alias(f"at_{c}") for c in [*low, *high]),
        *(F.min(c).alias(f"ex_{c}") for c in low),
        *(F.max(c).alias(f"ex_{c}") for c in high),
    ).where("n >= 3")
    hits = sum(((F.col(f"at_{c}") == F.col(f"ex_{c}")).cast("int") for c in [*low, *high]), F.lit(0))
    return g.select(key, "n", hits.alias("hits"))
