"""Runs of frames: segments, integer ranges, dwell segments of states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.operators import chunks
from strandlake.session import materialize


def segments_of(df: DataFrame, frames: str) -> DataFrame:
    """Add frame_segments, n_segments, max_consecutive_frames, first_frame, last_frame from an ascending array of distinct frames.

    The step is the greatest common divisor of the row's own gaps (1 for one frame), so a pair seen at 0 and 20 is one segment of
    two samples. Array functions only: no second shuffle. Lambdas name nothing but their own variables: Spark writes a column that is used once
    into its user, and one written into a lambda is found anew for every frame. ``let`` binds a value by a list of one."""
    let = lambda value, name, body: f"transform(array({value}), {name} -> {body})[0]"
    gaps = "if(size(f) < 2, array(1), transform(sequence(1, size(f) - 1), i -> f[i] - f[i-1]))"
    gcd = f"""aggregate(array_distinct({gaps}), 0, (g, d) -> aggregate(sequence(1, 46), named_struct('a', g, 'b', d),
               (s, i) -> if(s.b = 0, s, named_struct('a', s.b, 'b', cast(s.a % s.b as int))), s -> s.a))"""
    first = "filter(f, (x, i) -> i = 0 or x - f[i-1] <> step)"
    last = "filter(f, (x, i) -> i = size(f) - 1 or f[i+1] - x <> step)"
    runs = f"named_struct('step', step, 'segments', zip_with({first}, {last}, (s, e) -> named_struct('start', s, 'end', e)))"
    out = df.withColumn("_runs", F.expr(let(frames, "f", let(gcd, "step", runs))))
    return out.withColumns(
        {
            "frame_segments": F.col("_runs.segments"),
            "n_segments": F.size("_runs.segments").cast("long"),
            "max_consecutive_frames": F.expr("cast(array_max(transform(_runs.segments, s -> s.end - s.start)) div _runs.step + 1 as long)"),
            "first_frame": F.expr(f"cast({frames}[0] as long)"),
            "last_frame": F.expr(f"cast(element_at({frames}, -1) as long)"),
        }
    ).drop("_runs")


def pair_persistence(presence: DataFrame, keys: tuple[str, ...] = ("traj_id", "pair_id")) -> DataFrame:
    """Segments of each key's frames."""
    sets = presence.groupBy(*keys).agg(F.sort_array(F.collect_set("frame")).alias("frames"))
    return segments_of(sets.withColumn("contact_frames", F.size("frames").cast("long")), "frames").drop("frames")


def integer_ranges(values: DataFrame, value: str, keys: tuple[str, ...]) -> DataFrame:
    """Maximal runs of consecutive integers per key."""
    order = W.partitionBy(*keys).orderBy(value)
    island = values.select(*keys, value).distinct().withColumn("_g", F.col(value) - F.row_number().over(order))
    return island.groupBy(*keys, "_g").agg(F.min(value).alias("range_start"), F.max(value).alias("range_end")).drop("_g")


def dwell_segments(states: DataFrame, key: str = "traj_id", order: str = "frame", state: str = "state", time: str = "time_ps", span: int = chunks.SPAN) -> DataFrame:
    """Runs of one state in time order: first and last frame, samples, and duration (its span and one median interval).

    A sample is compared with the one before it, in its chunk of the series or the last of an earlier one; changes are a running sum over chunks."""
    sample = F.struct(F.col(order).alias("at"), F.col(time).alias("time"), F.col(state).alias("state"))
    rows = chunks.carry(chunks.cut(states, order, span), key, {"_last": sample}, F.max)
    before = F.coalesce(F.lag(sample).over(W.partitionBy(key, "chunk").orderBy(order)), F.col("_last_before"))
    changed = F.coalesce((F.col(state) != before["state"]).cast("int"), F.lit(0))
    rows = materialize(rows.select(key, "chunk", order, state, time, (F.col(time) - before["time"]).alias("_d"), changed.alias("_c")), "dwells")
    step = rows.groupBy(key).agg(F.coalesce(F.median("_d"), F.lit(0.0)).alias("_interval"))
    return (
        chunks.running(rows, key, order, {"run": F.col("_c")})
        .groupBy(key, "run", state)
        .agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"), (F.max(time) - F.min(time)).alias("_span"))
        .join(step, key)
        .withColumn("duration", F.col("_span") + F.col("_interval"))
        .drop("_span", "_interval")
    )


def dwell_summary(segments: DataFrame, key: str = "traj_id", state: str = "state") -> DataFrame:
    """Per state: visits, samples, mean dwell, first appearance, transitions in and out."""
    w = W.partitionBy(key).orderBy("run")
    marked = segments.withColumns({"_in": F.lag("run").over(w).isNotNull().cast("int"), "_out": F.lead("run").over(w).isNotNull().cast("int")})
    return marked.groupBy(key, state).agg(
        F.count("*").alias("n_visits"),
        F.sum("n").alias("n_frames"),
        F.avg("duration").alias("mean_dwell"),
        F.min("first").alias("first_seen"),
        F.sum("_in").alias("transitions_in"),
        F.sum("_out").alias("transitions_out"),
    )
