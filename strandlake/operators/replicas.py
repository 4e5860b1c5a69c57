"""Statistics over the replicas of a complex, and over the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def primary_replica(replicas: DataFrame, key: str = "complex_id", run: str = "run", length: str = "crossing", preferred: int = 3) -> DataFrame:
    """The preferred run, else the longest."""
    order = W.partitionBy(key).orderBy((F.col(run) == preferred).desc(), F.col(length).desc(), run)
    return replicas.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def collapse(replicas: DataFrame, numeric: list[str], labels: list[str], key: str = "complex_id", run: str = "run", preferred: int = 3, length: str = "crossing") -> DataFrame:
    """One row per key: means of the numbers, labels of the primary replica. One shuffle for everything."""
    rank = F.struct((F.col(run) == preferred).alias("p"), F.col(length).alias("l"), (-F.col(run)).alias("r"))
    return replicas.groupBy(key).agg(*(F.avg(c).alias(c) for c in numeric), *(F.max_by(c, rank).alias(c) for c in labels), F.count("*").alias("n_replicas"))


def replica_spread(replicas: DataFrame, value: str, tolerance: float | None, key: str = "complex_id") -> DataFrame:
    """Mean, n, half of the range, and whether the range is within the tolerance (null under two values)."""
    n, full = F.count(value), F.max(value) - F.min(value)
    ok = F.when(n >= 2, full <= F.lit(tolerance)) if tolerance is not None else F.lit(None).cast("boolean")
    return replicas.where(F.col(value).isNotNull()).groupBy(key).agg(F.avg(value).alias("mean"), n.alias("n"), (full / 2).alias("spread"), ok.alias("reproducible"))


def numeric_consensus(replicas: DataFrame, value: str, key: str = "complex_id") -> DataFrame:
    return replicas.where(F.col(value).isNotNull()).groupBy(key).agg(
        F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"), (F.max(value) - F.min(value)).alias("range"), F.count(value).alias("n")
    )


def majority_label(replicas: DataFrame, label: str, primary: DataFrame, key: str = "complex_id", tie_break: str | None = None) -> DataFrame:
    """The most common label; a tie falls to ``tie_break``, else to the primary's label if tied, else to the smallest. agree: null under two labels.

    primary: (key, primary_label)."""
    counts = replicas.where(F.col(label).isNotNull()).groupBy(key, label).agg(F.count("*").alias("c")).join(primary, key, "left")
    top = counts.withColumn("_t", F.max("c").over(W.partitionBy(key))).groupBy(key).agg(
        F.sum("c").alias("n_observed"),
        F.count("*").alias("n_labels"),
        F.count_if(F.col("c") == F.col("_t")).alias("_tied"),
        F.min(F.when(F.col("c") == F.col("_t"), F.col(label))).alias("_least"),
        F.max(F.when((F.col("c") == F.col("_t")) & (F.col(label) == F.col("primary_label")), F.col(label))).alias("_primary"),
    )
    tie = F.coalesce(F.lit(tie_break), F.col("_primary"), F.col("_least")) if tie_break else F.coalesce("_primary", "_least")
    return top.select(key, F.when(F.col("_tied") == 1, F.col("_least")).otherwise(tie).alias("label"), F.when(F.col("n_observed") >= 2, F.col("n_labels") == 1).alias("agree"), "n_observed")


def majority_bool(replicas: DataFrame, value: str, weight: str, key: str = "complex_id") -> DataFrame:
    """Strict majority; an even split asks whether the mean weight exceeds a half."""
    n, t = F.count(value), F.count_if(F.col(value))
    return replicas.groupBy(key).agg(
        F.when(2 * t != n, 2 * t > n).otherwise(F.avg(F.when(F.col(value).isNotNull(), F.col(weight))) > 0.5).alias("value"),
        F.when(n >= 2, (t == 0) | (t == n)).alias("agree"),
        n.alias("n_observed"),
    ).where("n_observed > 0")


def worst_label(replicas: DataFrame, label: str, order: list[str], key: str = "complex_id") -> DataFrame:
    """The worst label by ``order`` (mild to severe), each label's count, and whether all agree."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(label))
    return replicas.where(F.col(label).isNotNull()).groupBy(key).agg(
        F.max_by(label, F.struct(rank, label)).alias("consensus"),
        *(F.count_if(F.col(label) == x).alias(f"n_{x}") for x in order),
        F.when(F.count("*") >= 2, F.countDistinct(label) == 1).alias("reproducible"),
        F.count("*").alias("n"),
    )


def complex_rows(replicas: DataFrame, fields: list[str], flag: str, key: str = "complex_id", run: str = "run") -> DataFrame:
    """One row per complex with its replicas as an array of structs in run order, and whether all have the flag."""
    return replicas.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(run, *fields))).alias("replicas"), F.bool_and(flag).alias("all_flag"), F.count("*").alias("n_replicas"))


def distribution(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """n, mean, quartiles by linear interpolation, min, max."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), q.alias("_q"), F.min(value).alias("min"), F.max(value).alias("max"))
    return out.select(*keys, "n", "mean", F.col("_q")[0].alias("p25"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("p75"), "min", "max")


def grouped_distribution(df: DataFrame, value: str, key: str, least: int = 5, most: int = 8) -> DataFrame:
    return distribution(df, value, key).where(F.col("n") >= least).orderBy(F.desc("n"), key).limit(most)


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *columns)


def reproducibility(replicas: DataFrame, tolerances: dict[str, float], key: str = "complex_id") -> DataFrame:
    """Per metric: complexes with two or more values, and the share within tolerance. Metrics are unpivoted, so it is one pass."""
    long = replicas.unpivot([key], list(tolerances), "metric", "value").where("value IS NOT NULL")
    per = long.groupBy(key, "metric").agg(F.count("*").alias("n"), (F.max("value") - F.min("value")).alias("r")).where("n >= 2")
    tol = F.create_map(*(F.lit(x) for kv in tolerances.items() for x in kv))
    return per.groupBy("metric").agg(F.count("*").alias("n_complexes"), F.avg((F.col("r") <= tol[F.col("metric")]).cast("double")).alias("share_reproducible"))


def icc(df: DataFrame, value: str, key: str, k: int) -> DataFrame:
    """ICC(1,1) and ICC(1,k) over groups of exactly ``k`` values."""
    g = df.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v")).where(F.col("n") == k)
    s = g.agg(F.count("*").alias("groups"), F.var_samp("m").alias("vm"), F.avg("v").alias("vw"))
    msb, msw = k * F.col("vm"), F.col("vw") * k / (k - 1)
    return s.select("groups", ((msb - msw) / (msb + (k - 1) * msw)).alias("icc1"), ((msb - msw) / msb).alias("icck"))


def tukey_fences(df: DataFrame, value: str, stratum: str, k: float = 1.5, far: float = 3.0, least: int = 8, two_sided: bool = True) -> DataFrame:
    """Rows outside the quartile fences of their stratum, if it has at least ``least`` rows; ``far``: beyond the outer fence."""
    q = distribution(df, value, stratum).where(F.col("n") >= least).select(stratum, "p25", "p75")
    j = df.join(q, stratum)
    iqr, v = F.col("p75") - F.col("p25"), F.col(value)
    out = lambda m: (v > F.col("p75") + m * iqr) | ((v < F.col("p25") - m * iqr) if two_sided else F.lit(False))
    return j.where(out(k)).withColumn("far", out(far)).drop("p25", "p75")


def flag_tally(flags: DataFrame, entity: str, axis: str = "axis", far: str = "far", least: int = 2) -> DataFrame:
    """Entities flagged on at least ``least`` axes."""
    return flags.groupBy(entity).agg(F.countDistinct(axis).alias("n_axes"), F.count_if(F.col(far)).alias("n_far")).where(F.col("n_axes") >= least)


def duplicate_series(series: DataFrame, key: str = "traj_id", order: str = "frame", value: str = "value") -> DataFrame:
    """Groups of series with exactly the same values: by digest first, only equal digests' arrays are compared."""
    arrays = series.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]).alias("v"))
    return arrays.groupBy(F.sha2(F.to_json("v"), 256).alias("digest"), "v").agg(F.sort_array(F.collect_list(key)).alias("members")).where("size(members) > 1").select(F.size("members").alias("n"), F.col("members")[0].alias("first"))


def declared_vs_found(declared: DataFrame, found: DataFrame, key: str) -> DataFrame:
    a = declared.select(key).distinct().join(found, key, "left_anti").withColumn("side", F.lit("declared_only"))
    return a.unionByName(found.select(key).distinct().join(declared, key, "left_anti").withColumn("side", F.lit("found_only")))


def time_envelope(series: DataFrame, at: str, value: str, q: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Exact percentiles of all series at each time."""
    out = series.groupBy(at).agg(F.percentile(value, F.array(*map(F.lit, q))).alias("_q"), F.count("*").alias("n"))
    return out.select(at, "n", *(F.col("_q")[i].alias(f"p{round(100 * x)}") for i, x in enumerate(q)))


def equal_width_histogram(df: DataFrame, value: str, bins: int, cls: str) -> DataFrame:
    """Counts by bin between the extremes and by class; the last bin is closed."""
    ext = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    b = F.least(F.floor((F.col(value) - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / bins)), F.lit(bins - 1)).cast("int")
    return df.crossJoin(F.broadcast(ext)).groupBy(b.alias("bin"), cls).agg(F.count("*").alias("n"))


def trust_tier(df: DataFrame, level: str, consistent: str, reliable: str, n_soft: str) -> DataFrame:
    """A, B or C by demerits: dynamics low 2, medium 1; estimates disagree 1; decomposition unreliable 1; soft axes a half each, at most 1."""
    demerits: Column = (
        F.when(F.col(level) == "low", 2.0).when(F.col(level) == "medium", 1.0).otherwise(0.0)
        + F.when(~F.col(consistent), 1.0).otherwise(0.0)
        + F.when(~F.col(reliable), 1.0).otherwise(0.0)
        + F.least(F.coalesce(F.col(n_soft), F.lit(0)), F.lit(2)) * 0.5
    )
    reasons = F.array_compact(
        F.array(
            F.when(F.col(level).isin("low", "medium"), F.concat(F.col(level), F.lit(" dynamics trust"))),
            F.when(~F.col(consistent), "surface estimates disagree"),
            F.when(~F.col(reliable), "decomposition unreliable"),
            F.when(F.col(n_soft) > 0, F.concat(F.col(n_soft).cast("string"), F.lit(" axes near a boundary"))),
        )
    )
    return df.withColumns({"demerits": demerits, "reasons": reasons}).withColumn("tier", F.when(F.col("demerits") < 1, "A").when(F.col("demerits") < 3, "B").otherwise("C"))


def box_profile(df: DataFrame, value: str, *keys: str) -> DataFrame:
    q = (0.1, 0.25, 0.5, 0.75, 0.9)
    out = df.groupBy(*keys).agg(F.percentile(value, F.array(*map(F.lit, q))).alias("_q"), F.count("*").alias("n"))
    return out.select(*keys, "n", *(F.col("_q")[i].alias(f"p{round(100 * x)}") for i, x in enumerate(q)))


def compare_metrics(a: DataFrame, b: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """Full outer rows of two cases' metrics with difference and relative percent (null where the first is 0 or missing)."""
    x, y = a.select(metric, F.col(value).alias("a")), b.select(metric, F.col(value).alias("b"))
    d = F.col("b") - F.col("a")
    return x.join(y, metric, "full").withColumns({"delta": d, "relative_pct": F.when(F.col("a") != 0, 100 * d / F.abs("a"))})


def preflight(a: DataFrame, b: DataFrame, fields: list[str], key: str) -> DataFrame:
    """Per field of two cases: missing if either is null or empty, passed if equal as strings, else failed."""
    long = lambda df, name: df.select(key, *(F.col(f).cast("string").alias(f) for f in fields)).unpivot([key], fields, "field", name)
    j = long(a, "a").join(long(b, "b"), [key, "field"], "full")
    miss = F.col("a").isNull() | F.col("b").isNull() | (F.col("a") == "") | (F.col("b") == "")
    return j.withColumn("status", F.when(miss, "missing").when(F.col("a") == F.col("b"), "passed").otherwise("failed"))


def replica_pairs(replicas: DataFrame, key: str = "complex_id", run: str = "run", same: str | None = None) -> DataFrame:
    """Pairs of replicas of one complex, the first run before the second, of equal ``same`` if given."""
    on = [key, *([same] if same else [])]
    a, b = replicas.select(*on, F.col(run).alias("run_1")), replicas.select(*on, F.col(run).alias("run_2"))
    return a.join(b, on).where("run_1 < run_2")


def borrow_labels(labels: DataFrame, bad: DataFrame, key: str = "complex_id") -> DataFrame:
    """Give each bad replica the labels of the first good one of its complex; complexes without a good one keep none.

    labels: (key, run, item, label); bad: (key, run)."""
    good = labels.join(bad, [key, "run"], "left_anti")
    donor = good.groupBy(key).agg(F.min("run").alias("donor"))
    taken = good.join(donor, key).where("run = donor").select(key, "item", "donor", F.col("label").alias("borrowed"))
    return labels.join(bad, [key, "run"], "left_semi").join(taken, [key, "item"])
