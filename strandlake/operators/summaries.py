"""Summaries of pair tables, residue profiles and structures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.functions.labels import stability_label
from strandlake.session import materialize


def pair_occupancy(report: DataFrame) -> DataFrame:
    """Fill defaults of a pair report, infer a missing longest run as round(contact_frames / segments), and label stability."""
    number = lambda c, kind: F.expr(f"try_cast({c} as {kind})")
    r = report.withColumns(
        {
            "contact_frequency": F.coalesce(number("contact_frequency", "double"), F.lit(0.0)),
            "contact_frames": F.coalesce(number("contact_frames", "bigint"), F.lit(0)).cast("long"),
            "n_segments": F.coalesce(number("n_segments", "bigint"), F.lit(0)).cast("long"),
            "max_consecutive_frames": F.coalesce(number("max_consecutive_frames", "bigint"), F.lit(0)).cast("long"),
        }
    )
    inferred = F.bround(F.col("contact_frames") / F.greatest(F.col("n_segments"), F.lit(1))).cast("long")
    r = r.withColumn("max_consecutive_frames", F.when(F.col("max_consecutive_frames") == 0, inferred).otherwise(F.col("max_consecutive_frames")))
    r = r.withColumn("max_consecutive_fraction", F.coalesce(F.try_divide(F.col("max_consecutive_frames").cast("double"), F.col("total_frames").cast("double")), F.lit(0.0)))
    return r.withColumn("stability_label", stability_label(F.col("contact_frequency"), F.col("max_consecutive_fraction"), F.col("n_segments")))


def _share(label: str) -> Column:
    return F.avg((F.col("stability_label") == label).cast("double"))


def occupancy_summary(pairs: DataFrame, *keys: str) -> DataFrame:
    """Pairs, mean and median occupancy, mean longest fraction, and shares of stable and transient pairs, per group. Null keys are left out."""
    for k in keys:
        pairs = pairs.where(F.col(k).isNotNull())
    return pairs.groupBy(*keys).agg(
        F.count("*").alias("n_pairs"),
        F.avg("contact_frequency").alias("mean_occupancy"),
        F.median("contact_frequency").alias("median_occupancy"),
        F.avg("max_consecutive_fraction").alias("mean_max_consecutive_fraction"),
        _share("stable").alias("stable_pair_fraction"),
        _share("transient").alias("transient_pair_fraction"),
    )


def peptide_vs_mhc(pairs: DataFrame) -> DataFrame:
    group = F.when(F.col("interaction_class") == "peptide_tcr", "tcr_peptide").when(F.col("interaction_class") == "hla_tcr", "tcr_mhc")
    return occupancy_summary(pairs.withColumn("group", group), "group")


def region_summary(pairs: DataFrame) -> DataFrame:
    """Loops against the peptide and the two groove helices."""
    partner = F.when(F.col("interaction_class") == "peptide_tcr", "peptide").when(F.col("mhc_subregion").isin("alpha1_helix", "alpha2_helix"), F.col("mhc_subregion"))
    loops = pairs.where(F.col("tcr_region").isin("CDR1", "CDR2", "CDR3"))
    keyed = loops.withColumns({"tcr_region_group": F.concat_ws("_", "tcr_region", F.lower("tcr_chain")), "partner_region_group": partner})
    return occupancy_summary(keyed, "tcr_region_group", "partner_region_group").drop("transient_pair_fraction")


def stability_counts(pairs: DataFrame, *keys: str) -> DataFrame:
    return pairs.groupBy(*keys).agg(
        F.count("*").alias("n_pairs"), F.count_if(F.col("stability_label") == "stable").alias("n_stable"), F.count_if(F.col("stability_label") == "transient").alias("n_transient")
    )


def residue_rollup(pairs: DataFrame, side: int) -> DataFrame:
    """Per residue of one side: summed and largest frequency, and partners."""
    other = 3 - side
    return pairs.groupBy("traj_id", F.col(f"chain_id_{side}").alias("chain_id"), F.col(f"resid_{side}").alias("resid")).agg(
        F.sum("contact_frequency").alias("total_frequency"),
        F.max("contact_frequency").alias("max_frequency"),
        F.countDistinct(f"chain_id_{other}", f"resid_{other}").alias("n_partners"),
    )


def occupancy_matrix(pairs: DataFrame, rows: str, columns: str, values: list, value: str = "contact_frequency") -> DataFrame:
    """Largest value of each row and column label; columns are the given labels, absent cells 0."""
    return pairs.groupBy(rows).pivot(columns, values).agg(F.max(value)).na.fill(0.0).orderBy(rows)


def region_bundles(pairs: DataFrame) -> DataFrame:
    """Per loop: pairs in all, with the peptide, with the heavy chain, and with its groove."""
    cls = F.col("interaction_class")
    return pairs.where(F.col("tcr_region").isNotNull()).groupBy("tcr_chain", "tcr_region").agg(
        F.count("*").alias("n_total"),
        F.count_if(cls == "peptide_tcr").alias("n_peptide"),
        F.count_if(cls == "hla_tcr").alias("n_hla"),
        F.count_if((cls == "hla_tcr") & (F.col("mhc_region") == "groove")).alias("n_groove"),
    )


def decomposition(contacts: DataFrame, key: str = "traj_id") -> DataFrame:
    """Pair counts and occupancy by (region, partner), by chain, and in all, with shares of the total: one pass over the contacts."""
    sets = contacts.groupingSets([[F.col(key), F.col("region"), F.col("partner")], [F.col(key), F.col("chain")], [F.col(key)]], F.col(key), F.col("region"), F.col("partner"), F.col("chain"))
    sums = sets.agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.sum("occupancy").alias("occupancy"))
    level = F.when(F.col("region").isNotNull(), "region").when(F.col("chain").isNotNull(), "chain").otherwise("total")
    sums = sums.withColumn("level", level).drop("g")
    total = F.max(F.when(F.col("level") == "total", F.col("occupancy"))).over(W.partitionBy(key))  # nine rows a key
    return sums.withColumn("ratio", F.coalesce(F.try_divide(F.col("occupancy"), total), F.lit(0.0)))


def reliability(parts: DataFrame, key: str = "traj_id", most_pairs: int = 500, least_chain: float = 0.02) -> DataFrame:
    """Why a decomposition is not to be trusted: degenerate, then pair_count_outlier, then single_chain_collapse; null if it is."""
    at = lambda cond, col: F.coalesce(F.sum(F.when(cond, F.col(col))), F.lit(0))
    level, chain = F.col("level"), F.col("chain")
    flat = parts.groupBy(key).agg(
        at(level == "total", "n").cast("long").alias("n_pairs"),
        at(level == "total", "occupancy").cast("double").alias("occupancy_total"),
        at((level == "region") & F.col("region").isin("cdr1", "cdr2", "cdr3"), "occupancy").cast("double").alias("cdr_occupancy"),
        at((level == "chain") & (chain == "alpha"), "ratio").cast("double").alias("alpha"),
        at((level == "chain") & (chain == "beta"), "ratio").cast("double").alias("beta"),
        at((F.col("region") == "cdr3") & (F.col("partner") == "peptide"), "ratio").cast("double").alias("peptide_recognition"),
        at(F.col("region").isin("cdr1", "cdr2") & (F.col("partner") == "mhc"), "ratio").cast("double").alias("hla_restriction"),
    )
    some = F.col("occupancy_total") > 0
    reason = (
        F.when(some & (F.col("cdr_occupancy") == 0), "degenerate")
        .when(F.col("n_pairs") > most_pairs, "pair_count_outlier")
        .when(some & (F.least("alpha", "beta") < least_chain), "single_chain_collapse")
    )
    return flat.withColumn("unreliable_reason", reason)


def contact_entropy(pairs: DataFrame, key: str = "traj_id", value: str = "contact_frequency") -> DataFrame:
    """Shannon entropy of the normalised positive occupancies, over ln N too, and the share of the first one and three; from two pairs on."""
    w = W.partitionBy(key)
    p = pairs.where(F.col(value) > 0).select(key, (F.col(value) / F.sum(value).over(w)).alias("p"))
    p = p.withColumn("_rank", F.row_number().over(w.orderBy(F.desc("p"))))
    return (
        p.groupBy(key)
        .agg(
            F.count("*").alias("n_pairs"),
            F.sum(-F.col("p") * F.log("p")).alias("entropy_nats"),
            F.max("p").alias("top1_share"),
            F.sum(F.when(F.col("_rank") <= 3, F.col("p"))).alias("top3_share"),
        )
        .where("n_pairs >= 2")
        .withColumn("entropy_normalized", F.col("entropy_nats") / F.log("n_pairs"))
    )


def peptide_positions(contacts: DataFrame, rmsf: DataFrame, hbonds: DataFrame, loops: DataFrame, key: str = "traj_id") -> DataFrame:
    """One row per peptide residue with contacts or RMSF: largest occupancy, that to a third loop, partners, RMSF, largest hydrogen bond.

    contacts: (key, resid_1, chain_id_2, resid_2, contact_frequency); rmsf: (key, resid, rmsf); hbonds: (key, resid, contact_frequency);
    loops: (chain_id, resid) of the third loops."""
    in_loop = loops.select(F.col("chain_id").alias("chain_id_2"), F.col("resid").alias("resid_2"), F.lit(True).alias("_l")).distinct()
    c = contacts.join(in_loop, ["chain_id_2", "resid_2"], "left").groupBy(key, F.col("resid_1").alias("resid")).agg(
        F.max("contact_frequency").alias("tcr_contact"),
        F.max(F.when(F.col("_l"), F.col("contact_frequency"))).alias("cdr3_contact"),
        F.countDistinct("chain_id_2", "resid_2").alias("n_tcr_partners"),
    )
    h = hbonds.groupBy(key, "resid").agg(F.max("contact_frequency").alias("hbond"))
    out = c.join(rmsf, [key, "resid"], "full").join(h, [key, "resid"], "left")
    return out.select(
        key,
        "resid",
        F.dense_rank().over(W.partitionBy(key).orderBy("resid")).alias("position"),
        *(F.coalesce(x, F.lit(0.0)).alias(x) for x in ("tcr_contact", "cdr3_contact", "hbond")),
        F.coalesce("n_tcr_partners", F.lit(0)).alias("n_tcr_partners"),
        "rmsf",
    )


def hotspots(pairs: DataFrame, rmsf: DataFrame, most: int = 20, cutoff: float = 0.5, key: str = "traj_id") -> DataFrame:
    """Residues by 0.4 occupancy + 0.3 stability + 0.3 diversity: stability max(0, 1 - rmsf / 3), 0.5 without RMSF; diversity of up to five
    interaction families. Kept: score and occupancy of at least ``cutoff``, the best ``most`` of each trajectory.

    pairs: (key, interaction_family, chain_id_1, resid_1, chain_id_2, resid_2, contact_frequency), occupancy from family contact."""
    side = lambda a, b: F.struct(F.col(f"chain_id_{a}").alias("chain_id"), F.col(f"resid_{a}").alias("resid"), F.col(f"chain_id_{b}").alias("oc"), F.col(f"resid_{b}").alias("orr"))
    both = pairs.select(key, "interaction_family", "contact_frequency", F.explode(F.array(side("1", "2"), side("2", "1"))).alias("r"))
    contact = F.col("interaction_family") == "contact"
    res = both.groupBy(key, "r.chain_id", "r.resid").agg(
        F.max(F.when(contact, F.col("contact_frequency"))).alias("occupancy"),
        F.countDistinct("interaction_family").alias("n_interaction_types"),
        F.countDistinct(F.when(contact, F.struct("r.oc", "r.orr"))).alias("n_partners"),
    )
    stable = F.coalesce(F.greatest(F.lit(0.0), 1 - F.col("rmsf") / 3.0), F.lit(0.5))
    scored = res.where("occupancy > 0").join(rmsf, [key, "chain_id", "resid"], "left").withColumn(
        "score", 0.4 * F.col("occupancy") + 0.3 * stable + 0.3 * F.least(F.col("n_interaction_types"), F.lit(5)) / 5.0
    )
    order = W.partitionBy(key).orderBy(F.desc("score"), "chain_id", "resid")
    return scored.where((F.col("score") >= cutoff) & (F.col("occupancy") >= cutoff)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def rotamer_entropy(angles: DataFrame, keys: tuple[str, ...], angle: str, joint: str | None = None, floor: float = 0.05) -> DataFrame:
    """Entropy in bits over six 60-degree bins, and bins (of both angles with ``joint``) that hold at least ``floor``."""
    cell = lambda c: F.floor(F.pmod(F.col(c), F.lit(360.0)) / 60)
    binned = angles.select(*keys, cell(angle).alias("b"), (cell(joint) if joint else cell(angle)).alias("b2"))
    joint_n = binned.groupBy(*keys, "b", "b2").agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy(*keys))
    rows = joint_n.withColumn("p2", F.col("n") / total).groupBy(*keys, "b").agg(F.sum("p2").alias("p"), F.count_if(F.col("p2") >= floor).alias("full"))
    return rows.groupBy(*keys).agg(F.sum(-F.col("p") * F.log2("p")).alias("entropy_bits"), F.sum("full").alias("n_populated"))


def secondary_structure(codes: DataFrame, keys: tuple[str, ...] = ("traj_id", "resid"), code: str = "code") -> DataFrame:
    """Shares of helix (H, G, I), sheet (E, B) and the rest; the dominant one (ties: helix, sheet, loop) and its share."""
    helix, sheet = F.col(code).isin("H", "G", "I"), F.col(code).isin("E", "B")
    share = lambda c: F.avg(c.cast("double"))
    shares = codes.groupBy(*keys).agg(share(helix).alias("helix"), share(sheet).alias("sheet"), share(~helix & ~sheet).alias("loop"))
    top = F.greatest("helix", "sheet", "loop")
    return shares.withColumns({"dominant": F.when(F.col("helix") == top, "helix").when(F.col("sheet") == top, "sheet").otherwise("loop"), "stability": top})


def buried_area(areas: DataFrame, a: str = "sasa_a", b: str = "sasa_b", ab: str = "sasa_ab") -> DataFrame:
    """Add the buried surface (A + B - AB) / 2 and its share 2 BSA / (A + B), 0 without surface."""
    bsa = (F.col(a) + F.col(b) - F.col(ab)) / 2
    return areas.withColumns({"bsa": bsa, "interface_ratio": F.coalesce(F.try_divide(2 * bsa, F.col(a) + F.col(b)), F.lit(0.0))})


def reconcile_area(df: DataFrame, half: str, other: str, side: str, gap: float = 20.0, asymmetry: float = 12.0) -> DataFrame:
    """Percent gaps between two area estimates and between twice one side and the whole, and whether both are within limits."""
    pct = lambda a, b: 100 * F.abs(a - b) / F.greatest(b, F.lit(1e-6))
    out = df.withColumns({"gap_pct": pct(F.col(half), F.col(other)), "asymmetry_pct": pct(2 * F.col(side), F.col(half))})
    return out.withColumn("consistent", (F.col("gap_pct") <= gap) & (F.col("asymmetry_pct") <= asymmetry))


def describe(df: DataFrame, value: str, *keys: str, std: str = "samp") -> DataFrame:
    """mean, std, min, max, median and n of a value per group; ``std``: samp or pop."""
    f = F.stddev_samp if std == "samp" else F.stddev_pop
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), f(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.median(value).alias("median"), F.count(value).alias("n"))


def exact_quantiles(rows: DataFrame, name: str, value: str, qs: tuple[float, ...]) -> DataFrame:
    """(name, q, value): exact interpolated quantiles of each name's values, however many. Equal values become one row with their number, so a hot value gathers
    nowhere; distinct ones are sorted into ranges, counted a range, and only the ranges that hold a wanted rank are looked into."""
    distinct = rows.where(F.col(value).isNotNull()).groupBy(F.col(name).alias("name"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    placed = materialize(distinct.repartitionByRange("name", "v").withColumn("part", F.spark_partition_id()), "sorted")
    counts = placed.groupBy("name", "part").agg(F.sum("n").alias("n"))
    w = W.partitionBy("name")
    ranges = counts.withColumns({"before": F.sum("n").over(w.orderBy("part")) - F.col("n"), "total": F.sum("n").over(w)})
    wanted = ranges.withColumn("q", F.explode(F.array(*map(F.lit, qs)))).withColumn("rank", F.col("q") * (F.col("total") - 1))
    wanted = wanted.withColumn("place", F.explode(F.array(F.floor("rank"), F.ceil("rank")))).where((F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("n")))
    wanted = wanted.select("name", "part", "q", "rank", "place", (F.col("place") - F.col("before")).alias("i")).distinct()
    below = F.sum("n").over(W.partitionBy("name", "part").orderBy("v")) - F.col("n")
    numbered = placed.join(wanted.select("name", "part").distinct(), ["name", "part"], "left_semi").withColumn("below", below)
    held = (F.col("i") >= F.col("below")) & (F.col("i") < F.col("below") + F.col("n"))
    found = wanted.join(numbered, ["name", "part"]).where(held).groupBy("name", "q", "rank").agg(F.min_by("v", "place").alias("lo"), F.max_by("v", "place").alias("hi"))
    return found.select(F.col("name").alias(name), "q", (F.col("lo") + (F.col("rank") - F.floor("rank")) * (F.col("hi") - F.col("lo"))).alias("value"))


def above_percentile(df: DataFrame, value: str, q: float = 0.9) -> DataFrame:
    """Rows above the exact percentile of all rows."""
    limit = exact_quantiles(df.select(F.lit("all").alias("name"), value), "name", value, (q,)).select(F.col("value").alias("_limit"))  # one row
    return df.crossJoin(F.broadcast(limit)).where(F.col(value) > F.col("_limit")).drop("_limit")


def conservation(msa: DataFrame, n_seqs: DataFrame, keys: tuple[str, ...] = ("set_id", "pos"), least: float = 0.5) -> DataFrame:
    """1 - H / ln 20 of each alignment column, within [0, 1]; null under ``least`` of the sequences without a gap.

    msa: (set_id, pos, aa) with '-' as gap; n_seqs: (set_id, n)."""
    counts = msa.where("aa <> '-'").groupBy(*keys, "aa").agg(F.count("*").alias("c"))
    p = F.col("c") / F.sum("c").over(W.partitionBy(*keys))
    ent = counts.withColumn("_h", -p * F.log(p)).groupBy(*keys).agg(F.sum("c").alias("n_observed"), F.sum("_h").alias("_h"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("_h") / F.log(F.lit(20.0))))
    return ent.join(n_seqs, keys[0]).select(*keys, "n_observed", F.when(F.col("n_observed") >= least * F.col("n"), score).alias("conservation"))


def validation(facts: DataFrame, most_missing: float = 0.1) -> DataFrame:
    """Issues, status and score (0 to 100) of structures from facts (chains_normal, n_chains, coordinates_ok, has_protein, completeness).

    Score: 30 for the chain count (15 with any chain), 25 for coordinates, 25 for protein, 20 by completeness. No issue: valid, one: acceptable."""
    issue = lambda cond, text: F.when(~F.coalesce(cond, F.lit(False)), F.lit(text))
    normal, coords, protein = F.col("chains_normal"), F.col("coordinates_ok"), F.col("has_protein")
    issues = F.array_compact(
        F.array(
            issue(normal, "unusual_chain_count"),
            issue(coords, "unreasonable_coordinates"),
            issue(protein, "no_protein_found"),
            issue(F.col("completeness") >= 1 - most_missing, "significant_missing_residues"),
        )
    )
    score = F.when(normal, 30.0).when(F.col("n_chains") > 0, 15.0).otherwise(0.0) + F.when(coords, 25.0).otherwise(0.0) + F.when(protein, 25.0).otherwise(0.0) + 20 * F.col("completeness")
    out = facts.withColumn("issues", issues)
    n = F.size("issues")
    return out.withColumns({"status": F.when(n == 0, "valid").when(n == 1, "acceptable").otherwise("problematic"), "score": F.least(F.lit(100.0), score)})


def top_k(df: DataFrame, k: int, order: list[Column], *keys: str, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; the ranking limit lets Spark cut every partition first."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def tie_ranks(rows: DataFrame, value: str, keys: list[str], extra: dict[str, Column] | None = None) -> DataFrame:
    """(keys, value, n, extra sums, before, total): each distinct value once, how many rows have it, how many of its keys' rows are below it, and how many there are.

    Equal values meet before anything is sorted, so a hot value is one row. Distinct values are sorted by range; how many rows lie in the ranges before
    comes from one number per range. No group is ordered in one task."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"), *(F.sum(c).alias(name) for name, c in (extra or {}).items()))
    placed = materialize(counts.repartitionByRange(*keys, value).withColumn("_range", F.spark_partition_id()), "ranked")
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ranges = placed.groupBy(*keys, "_range").agg(F.sum("n").alias("_n"))
    ranges = ranges.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(W.partitionBy(*keys)).alias("total"))
    inside = F.sum("n").over(W.partitionBy(*keys, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, -1))
    met = placed.withColumn("_inside", F.coalesce(inside, F.lit(0)))
    on = [met["_range"] == ranges["_r"], *(met[k].eqNullSafe(ranges[f"_{k}"]) for k in keys)]
    return met.join(ranges, on).select(*keys, value, "n", *(extra or {}), (F.col("_before") + F.col("_inside")).alias("before"), "total")
