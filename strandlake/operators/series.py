"""Time series of a trajectory: blocks, moving averages, drift, equilibration grades, lagged moments.

Series are long tables (traj_id, frame, time, value). Windows and running sums go by chunks of frames (``operators/chunks.py``): no task meets a
whole series, however long."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.functions import statistics
from strandlake.operators import chunks, moments, summaries
from strandlake.session import materialize

KEY, ORDER, TIME, VALUE = "traj_id", "frame", "time_s", "value"


def numbered(series: DataFrame, span: int = chunks.SPAN) -> DataFrame:
    """Add i, the place from 0, and n, the samples of the series."""
    return chunks.numbered(series, KEY, ORDER, span=span).drop("chunk")


def block_means(series: DataFrame, n_blocks: int = 5, least: int = 10) -> DataFrame:
    """Mean and population deviation of n // k sized blocks, the last taking the rest; blocks under ``least`` samples make them fewer, two at least."""
    k = F.when(F.floor(F.col("n") / n_blocks) < least, F.greatest(F.lit(2), F.floor(F.col("n") / 10))).otherwise(F.lit(n_blocks))
    b = numbered(series).withColumn("k", k.cast("long")).withColumn("size", F.greatest(F.lit(1), F.floor(F.col("n") / F.col("k"))))
    block = F.least(F.floor(F.col("i") / F.col("size")), F.col("k") - 1)
    return b.groupBy(KEY, block.alias("block")).agg(F.count("*").alias("n"), F.avg(VALUE).alias("mean"), F.stddev_pop(VALUE).alias("std"))


def block_stability(blocks: DataFrame) -> DataFrame:
    """Coefficient of variation of the block means, and relative differences of the last two and of first and last."""
    last = F.max_by("mean", "block")
    before = F.element_at(F.transform(F.array_sort(F.collect_list(F.struct("block", "mean"))), lambda s: s["mean"]), -2)
    first = F.min_by("mean", "block")
    agg = blocks.groupBy(KEY).agg(F.count("*").alias("n_blocks"), F.avg("mean").alias("m"), F.stddev_pop("mean").alias("s"), last.alias("l"), first.alias("f"), before.alias("b")).where("n_blocks >= 2")
    return agg.select(
        KEY,
        "n_blocks",
        F.when(F.col("m") > 0, F.col("s") / F.col("m")).otherwise(0.0).alias("stability"),
        (F.abs(F.col("l") - F.col("b")) / F.abs("l")).alias("last_two"),
        (F.abs(F.col("l") - F.col("f")) / F.abs("f")).alias("first_last"),
    )


def moving_average(series: DataFrame, width: int = 10, span: int = chunks.SPAN) -> DataFrame:
    """Means of full trailing windows. Blocks of samples get the width - 1 samples before them."""
    w = W.partitionBy(KEY, "block").orderBy("i").rowsBetween(-(width - 1), 0)
    blocks = chunks.haloed(numbered(series, span), before=width - 1, size=span)
    return blocks.withColumn("moving", F.avg(VALUE).over(w)).where(F.col("own") & (F.col("i") >= width - 1)).drop("block", "own")


def trend(series: DataFrame, width: int = 10, threshold: float = 0.05) -> DataFrame:
    """Slope of the moving average (0 for up to ten values), and whether it exceeds threshold / span."""
    span = series.groupBy(KEY).agg((F.max(TIME) - F.min(TIME)).alias("span"))
    m = moving_average(series, width).groupBy(KEY).agg(F.count("*").alias("n"), F.regr_slope("moving", TIME).alias("s")).join(span, KEY)
    slope = F.when(F.col("n") > 10, F.col("s")).otherwise(0.0)
    return m.select(KEY, slope.alias("slope"), (F.abs(slope) > threshold / F.col("span")).alias("has_drift"))


def convergence_point(series: DataFrame, width: int = 10, threshold: float = 0.05, span: int = chunks.SPAN) -> DataFrame:
    """First place of the moving average whose trailing deviation is below ``threshold``, with more than a fifth left and over four fifths of
    it stable; null if there is none or under 20 values. A deviation's window, a tenth of the series, is a difference of running sums."""
    moving = materialize(moving_average(series, width, span), "moving")
    m = chunks.numbered(moving.drop("i", "n"), KEY, ORDER, mean="moving", span=span).select(KEY, ORDER, TIME, "chunk", "i", "n", (F.col("moving") - F.col("mean")).alias("c"))
    std = _deviations(m, lambda i, n: (F.greatest(i - F.greatest(F.lit(10), F.floor(n / 10)), F.lit(0)), i + 1), span).withColumn("ok", (F.col("std") < threshold).cast("double"))
    after = chunks.running(std, KEY, "i", {"stable": F.col("ok")}, ahead=True)
    left = F.col("n") - F.col("i")
    found = after.where((F.col("n") >= 20) & (F.col("ok") == 1) & (left > F.col("n") * 0.2) & (F.col("stable") / left > 0.8))
    return series.select(KEY).distinct().join(found.groupBy(KEY).agg(F.min("i").cast("int").alias("index"), F.min_by(TIME, "i").alias("time")), KEY, "left")


def _deviations(centred: DataFrame, window, span: int) -> DataFrame:
    """Population deviation of ``c`` over places lo <= i < hi, (lo, hi) = window(i, n), from running sums of c and its square looked up at both ends.

    centred: (traj_id, frame, time, chunk, i, n, c), c less the mean of its series. The result is written: what follows reads it twice."""
    sums = chunks.running(centred, KEY, "i", {"s": F.col("c"), "q": F.col("c") * F.col("c")})
    sums = materialize(sums.select(KEY, *(c for c in (ORDER, TIME) if c in centred.columns), "i", "n", F.struct("s", "q").alias("run")), "running")
    lo, hi = window(F.col("i"), F.col("n"))
    edge = lambda name, tag: sums.select(KEY, (F.col("i") + 1).alias(name), F.col("run").alias(tag))
    both = sums.drop("run").withColumns({"lo": lo, "hi": hi}).join(edge("hi", "b"), [KEY, "hi"]).join(edge("lo", "a"), [KEY, "lo"], "left")
    m = F.col("hi") - F.col("lo")
    total = lambda f: F.col(f"b.{f}") - F.coalesce(F.col(f"a.{f}"), F.lit(0.0))
    std = F.sqrt(F.greatest(F.lit(0.0), total("q") / m - (total("s") / m) * (total("s") / m)))
    return materialize(chunks.cut(both.withColumn("std", std), "i", span).drop("lo", "hi", "a", "b"), "deviations")


def grade(mean: Column, std: Column, converged: Column, fraction: Column) -> Column:
    """A to D: D above 0.8 mean or 0.15 deviation; then by coefficient of variation and early convergence."""
    cv = F.when(mean > 0, std / mean).otherwise(F.lit(float("inf")))
    return F.when((mean > 0.8) | (std > 0.15), "D").when((cv < 0.10) & converged & (fraction < 0.2), "A").when(cv < 0.15, "B").when(cv < 0.20, "C").otherwise("D")


def series_summary(series: DataFrame) -> DataFrame:
    return series.groupBy(KEY).agg(F.avg(VALUE).alias("mean"), F.stddev_pop(VALUE).alias("std"), F.min(VALUE).alias("min"), F.max(VALUE).alias("max"), F.count("*").alias("n"))


def drift(series: DataFrame) -> DataFrame:
    """Slope per sample, drift over the run in percent of the mean, r squared."""
    s = numbered(series).groupBy(KEY).agg(F.regr_slope(VALUE, "i").alias("slope"), F.regr_r2(VALUE, "i").alias("r_squared"), F.avg(VALUE).alias("mean"), F.count("*").alias("n"))
    return s.withColumn("drift_pct", 100 * F.abs(F.col("slope") * F.col("n") / F.col("mean"))).drop("n")


def equilibration(series: DataFrame, mean_limit: float = 1.0, max_limit: float = 1.3, slope_limit: float = 0.0015, per: float = 1000.0) -> DataFrame:
    """ok, drifting or outlier: the tail drops the first n // 10 samples; the slope is that of the last fifth, time over ``per``. From ten samples on."""
    s = numbered(series).where("n >= 10")
    tail, last = F.col("i") >= F.floor(F.col("n") / 10), F.col("i") >= F.floor(F.col("n") * 0.8)
    t, v = F.when(tail, F.col(VALUE)), F.when(last, F.col(VALUE))
    x = F.when(last, F.col(TIME) / per)
    g = s.groupBy(KEY).agg(
        F.avg(t).alias("tail_mean"), F.stddev_pop(t).alias("tail_std"), F.max(t).alias("tail_max"), (F.max(t) - F.min(t)).alias("tail_variation"), F.avg(v).alias("final_mean"), F.count(v).alias("_k"), F.regr_slope(v, x).alias("_s")
    )
    g = g.withColumn("drift_slope", F.when(F.col("_k") > 2, F.coalesce("_s", F.lit(0.0))).otherwise(0.0)).drop("_k", "_s")
    label = F.when((F.col("tail_mean") > mean_limit) | (F.col("tail_max") > max_limit), "outlier").when(F.col("drift_slope") > slope_limit, "drifting").otherwise("ok")
    return g.withColumn("equilibration", label)


def tail_variation(series: DataFrame, trim: float = 0.1) -> DataFrame:
    """Full and tail ranges; the tail begins at floor(trim * n), within the series."""
    s = numbered(series)
    start = F.least(F.col("n") - 1, F.floor(F.col("n") * trim))
    t, at = F.when(F.col("i") >= start, F.col(VALUE)), F.when(F.col("i") >= start, F.col(TIME))
    return s.groupBy(KEY).agg(
        (F.max(VALUE) - F.min(VALUE)).alias("full_variation"),
        (F.max(t) - F.min(t)).alias("tail_variation"),
        F.avg(t).alias("tail_mean"),
        F.stddev_pop(t).alias("tail_std"),
        F.min(at).alias("tail_start"),
        F.max(at).alias("tail_end"),
        F.count(t).alias("tail_n"),
    )


def drift_table(series: DataFrame, tail: float = 0.1, slope: float = 0.2, span: int = chunks.SPAN) -> DataFrame:
    """Tail mean and p95 - p5 band from round(tail (n - 1)), slope from round((1 - slope)(n - 1)), halves to even. The band's percentiles are exact, by ranges of values."""
    s = numbered(series, span)
    at = lambda x: F.bround(F.lit(x) * (F.col("n") - 1))
    in_tail = F.col("i") >= at(tail)
    last = F.col("i") >= at(1.0 - slope)
    q = summaries.exact_quantiles(s.where(in_tail), KEY, VALUE, (0.05, 0.95))
    pick = lambda x: F.max(F.when(F.col("q") == x, F.col("value")))
    band = q.groupBy(KEY).agg((pick(0.95) - pick(0.05)).alias("tail_band"))
    ends = s.groupBy(KEY).agg(F.avg(F.when(in_tail, F.col(VALUE))).alias("tail_mean"), F.regr_slope(F.when(last, F.col(VALUE)), F.when(last, F.col(TIME))).alias("slope"))
    return ends.join(band, KEY, "left").select(KEY, "tail_mean", "tail_band", "slope")


def energy_trend(blocks: DataFrame, similar: float = 0.05, drift: float = 0.02, key: str = KEY) -> DataFrame:
    """From block means (key, block, mean): percent difference of the last two and of the first and last block, slope and r squared of the means against
    their number, its p-value, and the verdict. A trend needs |r| > 0.7 and p < 0.05; converged: last two alike, no drift, no trend."""
    k = F.col("block").cast("double")
    ends = F.array_sort(F.collect_list(F.struct("block", "mean")))
    g = blocks.groupBy(key).agg(ends.alias("b"), F.count("*").alias("n_blocks"), F.regr_slope("mean", k).alias("slope"), F.corr("mean", k).alias("r")).where("n_blocks >= 2")
    last, before, first = F.element_at("b", -1)["mean"], F.element_at("b", -2)["mean"], F.element_at("b", 1)["mean"]
    pct = lambda a, b: 100 * F.abs(a - b) / F.abs(b)
    df = F.col("n_blocks") - 2
    # a perfect line has no t, and nothing is left to chance
    p = F.when(df <= 0, None).when(F.abs("r") > 1 - 1e-12, 0.0).otherwise(statistics.student_p(F.col("r") * F.sqrt(df / (1 - F.col("r") * F.col("r"))), df))
    g = g.select(key, "n_blocks", pct(before, last).alias("last_two_pct"), pct(last, first).alias("first_last_pct"), "slope", (F.col("r") * F.col("r")).alias("r_squared"), p.alias("p_value"))
    trend = F.coalesce((F.col("r_squared") > 0.49) & (F.col("p_value") < 0.05), F.lit(False))
    return g.withColumn("has_trend", trend).withColumn("is_converged", (F.col("last_two_pct") < 100 * similar) & (F.col("first_last_pct") < 100 * drift) & ~F.col("has_trend"))


def convergence_time(series: DataFrame, least: int = 100, step: float = 2.0, tolerance: float = 1.2, span: int = chunks.SPAN) -> DataFrame:
    """(traj_id, time): the first sample whose centred moving deviation, and that of the samples behind it, is at most ``tolerance`` times the mean one of the last fifth.

    The window reaches max(least, n // 20) samples to both sides, cut at the ends; the deviation must hold for max(least, n // 10) samples. Without such
    a sample a fifth of the series counts, series of fewer than ``least`` have no time. ``step``: time between samples. Windows are
    differences of running sums, centred first, so no sample is joined with its whole window."""
    c = chunks.numbered(series, KEY, ORDER, mean=VALUE, span=span).where(F.col("n") >= least).select(KEY, "chunk", "i", "n", (F.col(VALUE) - F.col("mean")).alias("c"))
    reach = lambda n: F.greatest(F.lit(least), F.floor(n / 20))
    dev = _deviations(c, lambda i, n: (F.greatest(i - reach(n), F.lit(0)), F.least(i + reach(n), n)), span)
    late = F.when(F.col("i") >= F.floor(F.col("n") * 0.8), F.col("std"))
    dev = chunks.carry(dev, KEY, {"late": late, "k": late.isNotNull().cast("long")})
    bad = F.when(F.col("std") > tolerance * F.try_divide("late_all", "k_all"), F.col("i"))
    hold = F.greatest(F.lit(least), F.floor(F.col("n") / 10))
    calm = chunks.running(dev.select(KEY, "chunk", "i", "n", bad.alias("bad")), KEY, "i", {"next_bad": F.col("bad")}, F.min, ahead=True)
    ok = F.col("next_bad").isNull() | (F.col("next_bad") >= F.col("i") + hold)
    first = F.min(F.when(ok & (F.col("i") >= reach(F.col("n"))) & (F.col("i") < F.col("n") - reach(F.col("n"))), F.col("i")))
    found = calm.groupBy(KEY, "n").agg(first.alias("first")).select(KEY, (F.coalesce(F.col("first").cast("double"), F.col("n") * 0.2) * step).alias("time"))
    return series.select(KEY).distinct().join(found, KEY, "left")


def stability_grades(series: DataFrame, limits: tuple[float, float, float], key: str = KEY) -> DataFrame:
    """Grade of the relative deviation in percent by three limits, and its points."""
    s = series.groupBy(key).agg((100 * F.stddev_pop(VALUE) / F.abs(F.avg(VALUE))).alias("pct"))
    a, b, c = limits
    g = F.when(F.col("pct") < a, "A").when(F.col("pct") < b, "B").when(F.col("pct") < c, "C").otherwise("D")
    points = F.create_map(*(F.lit(x) for kv in {"A": 100.0, "B": 80.0, "C": 60.0, "D": 40.0}.items() for x in kv))
    return s.withColumn("grade", g).withColumn("points", points[F.col("grade")])


def angle_summary(frames: DataFrame, angle: str, polarity: str, key: str = KEY) -> DataFrame:
    """Mean, population deviation and extremes of the angle, and of it folded by the sign of the polarity; share of reversed votes."""
    folded = F.when(F.col(polarity) < 0, 180 - F.col(angle)).otherwise(F.col(angle))
    vote = F.when(F.col(polarity) != 0, (F.col(polarity) < 0).cast("double"))
    return frames.groupBy(key).agg(F.avg(angle).alias("mean"), F.stddev_pop(angle).alias("std"), F.min(angle).alias("min"), F.max(angle).alias("max"), F.avg(folded).alias("directed_mean"), F.avg(vote).alias("reversed_fraction"))


def lagged_covariance(features: DataFrame, lag: int, span: int = 4096) -> DataFrame:
    """(traj_id, i, j, c00, ctt, c0t): covariances of the samples, of those ``lag`` later, and between both, each side centred on its own mean.

    features: (traj_id, frame, j, x). A frame's vector and the later one are one vector, whose second moments are partial matrices."""
    rows, names = moments.vectors_of(features, KEY, ORDER)
    later = F.lead("vector", lag).over(W.partitionBy(KEY, "block").orderBy("i"))
    blocks = chunks.haloed(chunks.numbered(rows, KEY, ORDER, span=span), after=lag, size=span)
    both = blocks.withColumn("later", later).where("own AND later IS NOT NULL").select(KEY, F.concat("vector", "later").alias("vector"))
    cov = moments.covariances(moments.second_moments(both, KEY, "vector"), KEY, 1).join(names, KEY)
    d = F.size("names")
    name = lambda c: F.col("names")[F.col(c) % d]
    pick = lambda cond: F.max(F.when(cond, F.col("cov")))
    early, late = F.col("a") < d, F.col("b") >= d
    return cov.groupBy(KEY, name("a").alias("i"), name("b").alias("j")).agg(pick(early & ~late).alias("c00"), pick(~early & late).alias("ctt"), pick(early & late).alias("c0t"))


def nearest_window(anchors: DataFrame, samples: DataFrame, radius: int, value: str = VALUE, span: int = chunks.SPAN) -> DataFrame:
    """Per anchor frame: the mean of the samples at most ``radius`` frames away, else the nearest sample's value (ties: the earlier).

    Frames are dealt into buckets as wide as the radius and samples copied to the next ones, so the range join is an equi-join; anchors
    without a sample in reach look up their neighbours by two running passes over chunks."""
    b = max(1, radius)
    near = samples.select(KEY, F.col(ORDER).alias("_s"), F.col(value).alias("_v"), F.explode(F.array(*(F.floor(F.col(ORDER) / b) + d for d in (-1, 0, 1)))).alias("_b"))
    a = anchors.select(KEY, ORDER).distinct().withColumn("_b", F.floor(F.col(ORDER) / b))
    inside = a.join(near, [KEY, "_b"]).where(F.abs(F.col("_s") - F.col(ORDER)) <= radius).groupBy(KEY, ORDER).agg(F.avg("_v").alias("inside"))
    marks = samples.select(KEY, F.col(ORDER), F.struct(F.col(ORDER).alias("f"), F.col(value).alias("v")).alias("s"), F.lit(0).alias("k")).unionByName(a.select(KEY, ORDER, F.lit(None).cast(f"struct<f:{samples.schema[ORDER].dataType.simpleString()},v:double>").alias("s"), F.lit(1).alias("k")))
    cut = chunks.cut(marks, ORDER, span)
    both = chunks.running(cut, KEY, ORDER, {"back": F.col("s")}, F.max)
    both = chunks.running(both, KEY, ORDER, {"fore": F.col("s")}, F.min, ahead=True).where("k = 1")
    nearest = F.when(F.col("fore").isNull() | (F.col(ORDER) - F.col("back.f") <= F.col("fore.f") - F.col(ORDER)), F.col("back.v")).otherwise(F.col("fore.v"))
    return both.select(KEY, ORDER, nearest.alias("nearest")).join(inside, [KEY, ORDER], "left").select(KEY, ORDER, F.coalesce("inside", "nearest").alias("value"), F.col("inside").isNotNull().alias("in_window"))


def align_series(series: DataFrame, metrics: list[str], digits: int = 6, key: str = KEY, metric: str = "metric", time: str = "time_ps") -> DataFrame:
    """One row per time that all metrics share, rounded to ``digits``, one column per metric."""
    at = series.withColumn("time", F.round(time, digits))
    wide = at.groupBy(key, "time").pivot(metric, metrics).agg(F.first(VALUE))
    return wide.where(" AND ".join(f"`{m}` IS NOT NULL" for m in metrics))


def common_times(series: DataFrame, group: str, time: str = "frame", key: str = "traj_id") -> DataFrame:
    """(group, first, second, time) of the times that two trajectories of a group both have, for all pairs."""
    t = series.select(group, key, time).distinct()
    return t.withColumnRenamed(key, "first").join(t.withColumnRenamed(key, "second"), [group, time]).where("first < second").select(group, "first", "second", time)
