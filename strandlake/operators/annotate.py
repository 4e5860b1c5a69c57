"""Residue semantics, pair annotation and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators import chunks

# Helix residue ranges of the groove, inclusive.
HELICES = (("alpha1_helix", 50, 86), ("alpha2_helix", 140, 176))


def residue_semantics(residues: DataFrame, chains: DataFrame, regions: DataFrame) -> DataFrame:
    """Component, side, and region labels of (chain_id, resid): role by chain, loops and helices by residue interval."""
    r = residues.join(chains, "chain_id", "left").withColumnRenamed("role", "component")
    loop = regions.withColumnRenamed("chain_id", "_c")
    r = r.join(loop, (F.col("chain_id") == F.col("_c")) & F.col("resid").between(F.col("resid_start"), F.col("resid_end")), "left").drop("_c", "resid_start", "resid_end")
    tcr, hla = F.col("component").isin("TCR_alpha", "TCR_beta"), F.col("component") == "HLA_alpha"
    phla = F.col("component").isin("HLA_alpha", "beta2m", "peptide")
    helix = F.lit(None).cast("string")
    for name, a, b in reversed(HELICES):
        helix = F.when(F.col("resid").between(a, b), name).otherwise(helix)
    return r.select(
        "chain_id",
        "resid",
        F.coalesce("component", F.lit("unknown")).alias("component"),
        F.when(tcr, "tcr").when(phla, "phla").otherwise("unknown").alias("complex_side"),
        F.when(phla, F.col("component")).alias("phla_region"),
        F.when(hla, F.when(helix.isNotNull(), "groove").otherwise("non_groove")).when(phla, F.col("component")).alias("mhc_region"),
        F.when(hla, F.coalesce(helix, F.lit("non_groove"))).when(phla, F.col("component")).alias("mhc_subregion"),
        F.when(tcr, F.replace("component", F.lit("TCR_"), F.lit(""))).alias("tcr_chain"),
        F.when(tcr, F.coalesce("region", F.lit("non_cdr"))).alias("tcr_region"),
    )


def _key(component: Column) -> Column:
    c = F.lower(component)
    return F.when(c.contains("peptide"), "peptide").when(c.contains("hla") | c.contains("mhc"), "hla").when(c.contains("beta2m"), "beta2m").when(c.contains("tcr"), "tcr").otherwise("other")


def annotate_pairs(pairs: DataFrame, semantics: DataFrame) -> DataFrame:
    """Join both sides of a pair table to the semantics and name the interaction class.

    One receptor side: <component>_tcr with the receptor's labels and the partner's; two different other components: their
    names in the order peptide, hla, beta2m, tcr, other; one component: intra_<name>."""
    out = pairs
    for t in ("1", "2"):
        side = semantics.select(F.col("chain_id").alias(f"chain_id_{t}"), F.col("resid").alias(f"resid_{t}"), *(F.col(c).alias(f"{c}_{t}") for c in semantics.columns[2:]))
        out = out.join(side, [f"chain_id_{t}", f"resid_{t}"], "left")
    one, two = F.col("complex_side_1") == "tcr", F.col("complex_side_2") == "tcr"
    single = F.coalesce(one, F.lit(False)) != F.coalesce(two, F.lit(False))
    pick = lambda name, receptor: F.when(single & one, F.col(f"{name}_{'1' if receptor else '2'}")).when(single & two, F.col(f"{name}_{'2' if receptor else '1'}"))
    partner = pick("component", False)
    k1, k2 = _key(F.col("component_1")), _key(F.col("component_2"))
    order = F.array(*map(F.lit, ("peptide", "hla", "beta2m", "tcr", "other")))
    r1, r2 = F.array_position(order, k1), F.array_position(order, k2)
    plain = (
        F.when(k1 == k2, F.when(k1 == "other", "other").otherwise(F.concat(F.lit("intra_"), k1)))
        .when(r1 < r2, F.concat_ws("_", k1, k2))
        .otherwise(F.concat_ws("_", k2, k1))
    )
    known = F.when(partner == "peptide", "peptide_tcr").when(partner == "HLA_alpha", "hla_tcr").when(partner == "beta2m", "beta2m_tcr").otherwise("other_tcr")
    subject = lambda name, other: F.when(k1 == k2, None).when(r1 < r2, F.col(f"{name}_{'2' if other else '1'}")).otherwise(F.col(f"{name}_{'1' if other else '2'}"))
    return out.select(
        *pairs.columns,
        F.when(single, known).otherwise(plain).alias("interaction_class"),
        pick("tcr_chain", True).alias("tcr_chain"),
        pick("tcr_region", True).alias("tcr_region"),
        F.when(single, F.coalesce(pick("phla_region", False), partner)).otherwise(subject("phla_region", False)).alias("phla_region"),
        F.when(single, pick("mhc_region", False)).otherwise(subject("mhc_region", True)).alias("mhc_region"),
        F.when(single, pick("mhc_subregion", False)).otherwise(subject("mhc_subregion", True)).alias("mhc_subregion"),
        F.when(single, partner).otherwise(subject("component", True)).alias("partner_component"),
    )


def select_atoms(atoms: DataFrame, chains: list[str] | None = None, resnames: list[str] | None = None, names: list[str] | None = None, heavy_only: bool = False, element: str | None = None, min_bfactor: float | None = None) -> DataFrame:
    """Atoms that meet every criterion given."""
    tests = [
        (chains, lambda: F.col("chain_id").isin(*chains)),
        (resnames, lambda: F.col("resname").isin(*resnames)),
        (names, lambda: F.col("name").isin(*names)),
        (heavy_only or None, lambda: ~F.col("name").startswith("H")),
        (element, lambda: F.col("element") == element),
        (min_bfactor, lambda: F.col("bfactor") >= min_bfactor),
    ]
    for given, test in tests:
        if given is not None:
            atoms = atoms.where(test())
    return atoms


def filter_pairs(pairs: DataFrame, **equal: str | None) -> DataFrame:
    """Rows whose columns equal the given values; None asks for nothing."""
    for column, value in equal.items():
        if value is not None:
            pairs = pairs.where(F.col(column) == value)
    return pairs


def downsample(series: DataFrame, k: int, key: str = "traj_id", order: str = "frame", span: int = chunks.SPAN) -> DataFrame:
    """Every (n // k)-th sample of each series, at least every one."""
    places = chunks.numbered(series.select(key, order, F.struct("*").alias("_row")), key, order, span=span)
    return places.where(F.col("i") % F.greatest(F.lit(1), F.floor(F.col("n") / k)) == 0).select("_row.*")


def locate(chains: DataFrame, loops: DataFrame) -> DataFrame:
    """Residues of loop strings found in a chain's sequence; unmatched loops keep a null residue.

    ``chains``: (chain_id, sequence, resids array); ``loops``: (chain_id, loop, seq)."""
    hit = chains.join(loops, "chain_id").withColumn("_at", F.expr("instr(sequence, seq)"))
    return hit.select("chain_id", "loop", F.explode_outer(F.expr("if(_at > 0 and length(seq) > 0, slice(resids, _at, length(seq)), null)")).alias("resid"))
