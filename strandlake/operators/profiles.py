"""Reports and profiles on top of pair tables, hotspots, clusters and samples."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.operators import chunks
from strandlake.functions import statistics
from strandlake.operators.summaries import tie_ranks


def receptor_report(pairs: DataFrame) -> DataFrame:
    """Rows with one receptor side, as receptor and partner columns; the longest run as a share of all frames."""
    one, two = F.col("complex_side_1") == "tcr", F.col("complex_side_2") == "tcr"
    side = lambda name, receptor: F.when(one, F.col(f"{name}_{1 if receptor else 2}")).otherwise(F.col(f"{name}_{2 if receptor else 1}"))
    return pairs.where(one != two).select(
        "traj_id",
        side("chain_id", True).alias("tcr_chain_id"),
        side("resid", True).alias("tcr_resid"),
        side("chain_id", False).alias("partner_chain_id"),
        side("resid", False).alias("partner_resid"),
        "contact_frequency",
        F.try_divide(F.col("max_consecutive_frames").cast("double"), F.col("total_frames").cast("double")).alias("max_consecutive_fraction"),
    )


def parse_pair_scope(lines: DataFrame, value: str = "value") -> DataFrame:
    """(chain_id_1, resid_1, chain_id_2, resid_2) from lines ``CHAIN:START-END $ CHAIN:START-END``; a single residue may stand for a range.

    Equal lines are parsed once: what is left after a shuffle, so the work does not depend on how the lines lie."""
    part = lambda i: F.trim(F.get(F.split(F.col(value), "\\$"), F.lit(i)))
    out = lines.select(value).distinct()
    for t in (1, 2):
        p = part(t - 1)
        first = F.regexp_extract(p, "^(\\w+):(\\d+)", 2).try_cast("int")
        last = F.coalesce(F.regexp_extract(p, "^\\w+:\\d+-(\\d+)$", 1).try_cast("int"), first)
        out = out.withColumns({f"chain_id_{t}": F.regexp_extract(p, "^(\\w+):", 1), f"_r{t}": F.when(first <= last, F.sequence(first, last))})
    # outer: a filter of the arrays would be parsed again before the lines are made distinct
    pairs = out.select("chain_id_1", F.explode_outer("_r1").alias("resid_1"), "chain_id_2", "_r2").select("chain_id_1", "resid_1", "chain_id_2", F.explode_outer("_r2").alias("resid_2"))
    return pairs.where("resid_1 IS NOT NULL AND resid_2 IS NOT NULL").distinct()


def anchors(positions: DataFrame, structure: DataFrame, keys: list[str], sasa: float = 0.20, contact: float = 0.20) -> DataFrame:
    """Add relative surface and contact of each position, and whether it is an anchor: both below their limits."""
    j = positions.join(structure, keys, "left")
    return j.withColumn("is_anchor", (F.col("relative_sasa") < sasa) & (F.col("tcr_contact") < contact))


def mutation_candidates(spots: DataFrame, suggestions: DataFrame, most: int = 8, key: str = "traj_id") -> DataFrame:
    """Peptide, third-loop and heavy-chain hotspots in order of score, with the residue's suggestion or an alanine scan; the first ``most``."""
    kind = (
        F.when(F.col("side") == "peptide", "peptide TCR-facing (escape candidate)")
        .when((F.col("side") == "tcr") & (F.col("region") == "cdr3"), "CDR3 affinity / specificity")
        .when(F.col("side") == "hla", "HLA contact / restriction")
    )
    j = spots.withColumn("candidate_type", kind).where("candidate_type IS NOT NULL").join(suggestions, "resname", "left")
    text = F.coalesce("suggestion", F.lit("Ala scan"))
    order = W.partitionBy(key).orderBy(F.desc("score"), "chain_id", "resid")
    return j.withColumns({"suggestion": text, "rank": F.row_number().over(order)}).where(F.col("rank") <= most)


def position_means(rows: DataFrame, length: int, value: str, n: str = "n_positions", position: str = "position") -> DataFrame:
    """Mean by position over the entities of one length."""
    return rows.where(F.col(n) == length).groupBy(position).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def map_conservation(residues: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Each numbered residue's conservation and class; insertion codes have no column and stay uncovered."""
    from strandlake.functions.numbering import conservation_class, imgt_region

    s = scores.select(key, F.col("pos").alias("position"), "conservation").withColumn("insertion", F.lit(""))
    j = residues.join(s, [key, "position", "insertion"], "left")
    return j.withColumns({"class": conservation_class(F.col("conservation")), "region": imgt_region(F.col("position"))})


def community_table(nodes: DataFrame, key: str = "traj_id") -> DataFrame:
    """Communities (key, label, chain, resseq, role; negative labels left out) by size rank, with the count of each role."""
    n = nodes.where("label >= 0").groupBy(key, "label", "role").agg(F.count("*").alias("n"))
    c = n.groupBy(key, "label").agg(F.sum("n").alias("size"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "n")))).alias("roles"))
    return c.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("size"), "label")))


def cluster_medoids(distances: DataFrame, labels: DataFrame) -> DataFrame:
    """Each cluster's medoid (least mean distance to its members; ties: the earlier frame), population, and mean distance to other clusters.

    distances: (traj_id, a, b, d), both directions; labels: (traj_id, frame, cluster)."""
    one = labels.select("traj_id", F.col("frame").alias("a"), F.col("cluster").alias("ca"))
    two = labels.select("traj_id", F.col("frame").alias("b"), F.col("cluster").alias("cb"))
    j = distances.join(one, ["traj_id", "a"]).join(two, ["traj_id", "b"])
    size = labels.groupBy("traj_id", "cluster").agg(F.count("*").alias("n"))
    total = labels.groupBy("traj_id").agg(F.count("*").alias("total"))
    inner = labels.select("traj_id", F.col("frame").alias("a"), F.col("cluster").alias("ca")).join(
        j.where("ca = cb").groupBy("traj_id", "a").agg(F.sum("d").alias("s")), ["traj_id", "a"], "left"
    ).groupBy("traj_id", F.col("ca").alias("cluster")).agg(F.min_by("a", F.struct(F.round(F.coalesce("s", F.lit(0.0)), 9), "a")).alias("medoid"))
    outer = j.where("ca <> cb").groupBy("traj_id", F.col("ca").alias("cluster")).agg(F.avg("d").alias("mean_to_others"))
    return size.join(total, "traj_id").join(inner, ["traj_id", "cluster"]).join(outer, ["traj_id", "cluster"], "left").select(
        "traj_id", "cluster", "n", (F.col("n") / F.col("total")).alias("population"), "medoid", "mean_to_others"
    )


def cluster_medoids_on_line(values: DataFrame, value: str = "x", per_chunk: int = chunks.SPAN) -> DataFrame:
    """``cluster_medoids`` of distances that are differences of one value, without a row per pair: values (traj_id, frame, cluster, value).

    With its values in order, a frame's sum of distances follows from how many are up to it and their sum, in its cluster and in its trajectory: running sums over
    chunks of the value, in decimals of 15 places, so that frames of equal sums stay equal. Values reach up to 1e10; frames without one are left out."""
    x = F.col(value).cast("double")
    rows = values.where(x.isNotNull()).select("traj_id", "frame", "cluster", x.alias("x"), F.struct("traj_id", "cluster").alias("_g"))
    ends = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n")).first()  # one row
    span = (ends["hi"] - ends["lo"]) / max(1, -(-ends["n"] // per_chunk)) if ends["n"] else 0.0
    exact = {"_c": F.lit(1), "_p": F.col("x").cast("decimal(25,15)")}
    known = rows
    for key, side in (("traj_id", "all"), ("_g", "own")):
        cut = chunks.running(chunks.cut(known, "x", span or 1.0), key, "x", exact).drop("chunk")
        total = rows.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias(f"n_{side}"), F.sum(exact["_p"]).alias(f"t_{side}"))
        place = (2 * F.col("_c") - F.col(f"n_{side}")).cast("decimal(12,0)")
        known = cut.join(total, F.col(key).eqNullSafe(F.col("_k"))).withColumn(f"s_{side}", exact["_p"] * place + F.col(f"t_{side}") - 2 * F.col("_p")).drop("_c", "_p", "_k", f"t_{side}")
    n, total = F.max("n_own"), F.max("n_all")
    out = F.sum(F.col("s_all") - F.col("s_own")).cast("double")
    medoid = F.min_by("frame", F.struct(F.round("s_own", 9), "frame"))
    return known.groupBy("traj_id", "cluster").agg(n.alias("n"), (n / total).alias("population"), medoid.alias("medoid"), F.try_divide(out, (n * (total - n)).cast("double")).alias("mean_to_others"))


def cluster_signatures(presence: DataFrame, labels: DataFrame, most: int = 15) -> DataFrame:
    """Features (traj_id, frame, feature) that mark a cluster: occupancy there, difference to the frames outside, score = occupancy * max(difference, 0)."""
    size = labels.groupBy("traj_id", "cluster").agg(F.count("*").alias("n"))
    total = labels.groupBy("traj_id").agg(F.count("*").alias("total"))
    seen = presence.join(labels, ["traj_id", "frame"]).groupBy("traj_id", "feature", "cluster").agg(F.count("*").alias("k"))
    all_ = seen.groupBy("traj_id", "feature").agg(F.sum("k").alias("k_all"))
    g = seen.join(all_, ["traj_id", "feature"]).join(size, ["traj_id", "cluster"]).join(total, "traj_id")
    occ = F.col("k") / F.col("n")
    other = F.coalesce(F.try_divide((F.col("k_all") - F.col("k")).cast("double"), (F.col("total") - F.col("n")).cast("double")), F.lit(0.0))
    g = g.select("traj_id", "cluster", "feature", occ.alias("occupancy"), (occ - other).alias("delta"))
    g = g.withColumn("score", F.col("occupancy") * F.greatest(F.col("delta"), F.lit(0.0)))
    order = W.partitionBy("traj_id", "cluster").orderBy(F.round("score", 9).desc(), "feature")
    return g.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _joined(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows of both sides with equal keys, nulls being equal."""
    right = b.select(*(F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in b.columns))
    return a.join(right, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).drop(*(f"_{k}" for k in keys)) if keys else a.join(right)


def two_samples(df: DataFrame, value: str, is_first: Column, *keys: str) -> DataFrame:
    """Means, deviations, medians, Welch's t with its degrees of freedom, Cohen's d, and the rank-sum statistic with average ranks."""
    return _two_samples(df, value, is_first, *keys).drop("ties")


def _two_samples(df: DataFrame, value: str, is_first: Column, *keys: str) -> DataFrame:
    v = df.select(*keys, F.col(value).alias("v"), is_first.alias("f")).where("v IS NOT NULL")
    ranks = tie_ranks(v, "v", list(keys), {"m": F.when(F.col("f"), 1).otherwise(0)})
    n = F.col("n").cast("double")
    ranked = ranks.groupBy(*keys).agg(F.sum(F.col("m") * (F.col("before") + (n + 1) / 2)).alias("rs"), F.sum(n * n * n - n).alias("ties"))
    one, two = F.when(F.col("f"), F.col("v")), F.when(~F.col("f"), F.col("v"))
    g = v.groupBy(*keys).agg(
        F.count(one).alias("n1"), F.count(two).alias("n2"), F.avg(one).alias("mean1"), F.avg(two).alias("mean2"), F.var_samp(one).alias("v1"), F.var_samp(two).alias("v2"),
        F.median(one).alias("median1"), F.median(two).alias("median2"),
    )
    a, b = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2))
    return _joined(g, ranked, keys).select(
        *keys, "n1", "n2", "mean1", "mean2", F.sqrt("v1").alias("sd1"), F.sqrt("v2").alias("sd2"), "median1", "median2",
        ((F.col("mean1") - F.col("mean2")) / F.sqrt(a + b)).alias("welch_t"),
        ((a + b) * (a + b) / (a * a / (F.col("n1") - 1) + b * b / (F.col("n2") - 1))).alias("welch_df"),
        ((F.col("mean1") - F.col("mean2")) / pooled).alias("cohen_d"),
        F.when(F.col("n1") > 0, F.col("rs") - F.col("n1") * (F.col("n1") + 1) / 2.0).alias("u"), "ties",
    )


def two_sample_tests(df: DataFrame, value: str, is_first: Column, *keys: str) -> DataFrame:
    """``two_samples`` with two-sided p-values: of Welch's t, and of the rank sum by its normal limit, corrected for ties and continuity."""
    s = _two_samples(df.where(is_first.isNotNull()), value, is_first, *keys)
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n, mu = n1 + n2, n1 * n2 / 2
    spread = F.sqrt(n1 * n2 / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1))))
    z = F.when(spread > 0, F.greatest(F.lit(0.0), F.abs(F.col("u") - mu) - 0.5) / spread)
    return s.withColumns({"welch_p": statistics.student_p(F.col("welch_t"), F.col("welch_df")), "u_p": statistics.normal_p(z)}).drop("ties")


# Royston's polynomials (1995) of the two outermost weights in 1 / sqrt(n), and of mean and log deviation of log(1 - W) in log(n), from the constant on.
_LAST = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
_SECOND = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
_SPREAD = (-0.4803, -0.082676, 0.0030302)


def normality(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, n, w, p): Shapiro and Wilk's W of each group with 12 values or more that are not all equal, and its p-value.

    W's weights are expected normal order statistics, approximated from ranks. A distinct value's weight is the sum over the ranks of its rows, so
    tasks send a few sums per group; nothing is ordered in one task."""
    v = df.select(*keys, F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    ranks = tie_ranks(v, "v", list(keys)).where("total >= 12")
    inverse = NormalDist().inv_cdf
    quantile = lambda at, n: np.array([inverse((i - 0.375) / (n + 0.25)) for i in at])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums, squares = [], []
            for n, before, total in zip(*(b[c].to_pylist() for c in ("n", "before", "total"))):
                s = q = 0.0
                for k in range(before + 1, before + n + 1, 100_000):
                    m = quantile(range(k, min(k + 100_000, before + n + 1)), total)
                    s, q = s + m.sum(), q + (m * m).sum()
                sums.append(s)
                squares.append(q)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sums, pa.float64()), pa.array(squares, pa.float64())], [*b.schema.names, "s", "q"])

    declared = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranks.schema)
    scored = ranks.mapInArrow(score, declared + ", s double, q double")
    place = lambda k: F.max(F.when((F.col("before") < k) & (k <= F.col("before") + F.col("n")), F.col("v")))
    total = F.col("total")
    g = scored.groupBy(*keys, "total").agg(
        F.sum(F.col("s") * F.col("v")).alias("sv"), F.sum("q").alias("ssq"),
        *(place(p).alias(name) for name, p in (("x1", F.lit(1)), ("x2", F.lit(2)), ("y2", total - 1), ("y1", total))),
    )
    means = scored.groupBy(*keys).agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("mean"))
    around = _joined(scored, means, keys).groupBy(*keys).agg(F.sum(F.col("n") * (F.col("v") - F.col("mean")) * (F.col("v") - F.col("mean"))).alias("ss"))
    found = _joined(g, around, keys).where("ss > 0")
    names = [*keys, "total", "sv", "ssq", "x1", "x2", "y2", "y1", "ss"]

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        poly = np.polynomial.polynomial.polyval
        for b in batches:
            n, sv, ssq, x1, x2, y2, y1, ss = (b[c].to_numpy(zero_copy_only=False).astype(float) for c in names[len(keys) :])
            m1, m2 = (np.array([inverse((t - back - 0.375) / (t + 0.25)) for t in n]) for back in (0, 1))
            u = 1 / np.sqrt(n)
            a1, a2 = poly(u, _LAST) + m1 / np.sqrt(ssq), poly(u, _SECOND) + m2 / np.sqrt(ssq)
            scale = np.sqrt((ssq - 2 * m1**2 - 2 * m2**2) / (1 - 2 * a1**2 - 2 * a2**2))
            inner = sv - m1 * (y1 - x1) - m2 * (y2 - x2)
            w = np.minimum((inner / scale + a1 * (y1 - x1) + a2 * (y2 - x2)) ** 2 / ss, 1 - 1e-15)
            y = np.log(n)
            z = (np.log1p(-w) - poly(y, _MEAN)) / np.exp(poly(y, _SPREAD))
            yield pa.RecordBatch.from_arrays([*(b[k] for k in keys), b["total"], pa.array(w), pa.array([0.5 * math.erfc(t / math.sqrt(2)) for t in z], pa.float64())], [*keys, "n", "w", "p"])

    kinds = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)
    return found.select(*names).mapInArrow(close, kinds + "n long, w double, p double")


def compare_samples(df: DataFrame, value: str, is_first: Column, *keys: str, least: int = 50, alpha: float = 0.05) -> DataFrame:
    """``two_sample_tests`` with the test that fits: Welch's t if both samples have ``least`` values or more and neither departs from normality (p above ``alpha``), else the
    rank sum; its p-value, and whether that is below ``alpha``."""
    tests = two_sample_tests(df, value, is_first, *keys)
    both = normality(df.where(is_first.isNotNull()).select(*keys, value, is_first.alias("_first")), value, *keys, "_first")
    of = lambda name, side: F.max(F.when(F.col("_first") == side, F.col(name)))
    wide = both.groupBy(*keys).agg(of("w", True).alias("w1"), of("p", True).alias("normal_p1"), of("w", False).alias("w2"), of("p", False).alias("normal_p2"))
    right = wide.select(*(F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in wide.columns))
    met = tests.join(right, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] or F.lit(True), "left").drop(*(f"_{k}" for k in keys))
    normal = (F.col("n1") >= least) & (F.col("n2") >= least) & (F.col("normal_p1") > alpha) & (F.col("normal_p2") > alpha)
    chosen = met.withColumn("test", F.when(normal, "ttest").otherwise("wilcoxon"))
    p = F.when(F.col("test") == "ttest", F.col("welch_p")).otherwise(F.col("u_p"))
    return chosen.withColumns({"p_value": p, "significant": p < alpha})


def bootstrap_mean(df: DataFrame, value: str, key: str, draws: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """(key, mean, low, high): the mean and its bootstrap interval.

    Each draw takes a Poisson number of copies of each distinct value, seeded by key and value, so the interval does not depend on how rows are dealt. Tasks send sums of
    all draws, one row a key."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    seeded = counts.withColumn("s", F.xxhash64(F.lit(seed), "k", "v"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        kind = None
        for b in batches:
            kind = b["k"].type
            for k, v, n, s in zip(*(b[c].to_pylist() for c in ("k", "v", "n", "s"))):
                copies = np.random.default_rng(s & 0xFFFFFFFFFFFFFFFF).poisson(n, draws)
                x = sums.setdefault(k, np.zeros((4, draws)))
                x += (copies * v, copies, np.full(draws, n * v), np.full(draws, n))
        if sums:
            lists = [pa.array([x[i] for x in sums.values()], pa.list_(pa.float64())) for i in (0, 1)]
            totals = [pa.array([x[i, 0] for x in sums.values()]) for i in (2, 3)]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), kind), *lists, *totals], ["k", "total", "copies", "sum", "n"])

    kind = df.schema[key].dataType.simpleString()

    def close(t: pa.Table) -> pa.Table:
        total, copies = (np.stack([x.values.to_numpy() for x in t[c]]).sum(0) for c in ("total", "copies"))
        means = total[copies > 0] / copies[copies > 0]
        low, high = np.percentile(means, [50 - 50 * level, 50 + 50 * level])
        return pa.table({"k": t["k"].slice(0, 1), "mean": [sum(t["sum"].to_pylist()) / sum(t["n"].to_pylist())], "low": [float(low)], "high": [float(high)]})

    sums = seeded.mapInArrow(draw, f"k {kind}, total array<double>, copies array<double>, sum double, n double")
    return sums.groupBy("k").applyInArrow(close, f"k {kind}, mean double, low double, high double").withColumnRenamed("k", key)


def pair_group(role_1: Column, role_2: Column) -> Column:
    """anchor (peptide and heavy chain), specificity (peptide and receptor), restriction (heavy chain and receptor), else null."""
    key = F.array_join(F.array_sort(F.array(role_1, role_2)), "+")
    return F.when(key == "mhc+peptide", "anchor").when(key == "peptide+tcr", "specificity").when(key == "mhc+tcr", "restriction")


def grouped_pairs(pairs: DataFrame, roles: DataFrame, most: int = 12, key: str = "traj_id") -> DataFrame:
    """Pairs between different roles by group, the ``most`` of largest occupancy per trajectory and family, with the longest run's share.

    roles: (chain_id, role), a row per chain."""
    j = pairs
    for t in ("1", "2"):
        j = j.join(roles.select(F.col("chain_id").alias(f"chain_id_{t}"), F.col("role").alias(f"role_{t}")), f"chain_id_{t}", "left")
    j = j.withColumn("group", pair_group(F.col("role_1"), F.col("role_2"))).where("group IS NOT NULL AND contact_frequency > 0")
    longest = F.try_divide(F.col("max_consecutive_frames").cast("double"), F.col("total_frames").cast("double"))
    order = W.partitionBy(key, "interaction_family").orderBy(F.round("contact_frequency", 9).desc(), "chain_id_1", "resid_1", "chain_id_2", "resid_2")
    return j.withColumns({"longest_frac": longest, "rank": F.row_number().over(order)}).where(F.col("rank") <= most)


def manifest_row(meta: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """One flat row per record: each field is the first available value of its paths into the nested record."""
    return meta.select(*(F.coalesce(*(F.col(p) for p in paths)).alias(name) for name, paths in fields.items()))
