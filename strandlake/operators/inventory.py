"""File and batch inventories: completeness, issues, duplicates, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def completeness(files: DataFrame, key: str = "dir") -> DataFrame:
    """Status and score of each directory from its files (is_structure, is_trajectory): both 100, a trajectory alone 50, else 0."""
    g = files.groupBy(key).agg(F.bool_or("is_structure").alias("has_structure"), F.bool_or("is_trajectory").alias("has_trajectory"))
    both = F.col("has_structure") & F.col("has_trajectory")
    return g.withColumns({"status": F.when(both, "complete").otherwise("incomplete"), "score": F.when(both, 100.0).when(F.col("has_trajectory"), 50.0).otherwise(0.0)})


def issue_frequency(records: DataFrame, severity: dict[str, int], most: int = 10) -> DataFrame:
    """The issues by severity times frequency; unknown ones weigh 1."""
    n = records.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))
    weight = F.coalesce(F.create_map(*(F.lit(x) for kv in severity.items() for x in kv))[F.col("issue")], F.lit(1))
    return n.withColumn("impact", (F.col("n") * weight).cast("long")).orderBy(F.desc("impact"), "issue").limit(most)


def count_shares(df: DataFrame, value: str) -> DataFrame:
    n = df.groupBy(value).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("_t"))
    return n.crossJoin(F.broadcast(total)).select(value, "n", (F.col("n") / F.col("_t")).alias("share"))


def duplicates(entries: DataFrame, key: str = "id", batch: str = "batch") -> DataFrame:
    """Identifiers that occur more than once, and in how many batches."""
    return entries.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct(batch).alias("n_batches")).where("n > 1")


def occurrence_histogram(entries: DataFrame, key: str = "id") -> DataFrame:
    return entries.groupBy(key).agg(F.count("*").alias("occurrences")).groupBy("occurrences").agg(F.count("*").alias("n"))


def retained(entries: DataFrame, when: str, days: int, known: DataFrame, key: str) -> DataFrame:
    """Entries not older than ``days`` before the newest one and with a known key."""
    newest = entries.agg(F.max(when).alias("_m"))
    recent = entries.crossJoin(F.broadcast(newest)).where(F.col(when) >= F.col("_m") - F.expr(f"INTERVAL {days} DAY")).drop("_m")
    return recent.join(known, key, "left_semi")


def success(entries: DataFrame, batch: str = "batch", ok: str = "ok") -> DataFrame:
    return entries.groupBy(batch).agg(F.count("*").alias("n"), F.count_if(F.col(ok)).alias("n_ok"), F.count_if(~F.col(ok)).alias("n_failed"), (F.count_if(F.col(ok)) / F.count("*")).alias("rate"))


def lineage(entries: DataFrame, key: str, variant: str, strength: str, spelled: int = 3) -> DataFrame:
    """Variants of each lineage, spelled out if few, and the fold between the strongest and the weakest."""
    v = F.sort_array(F.collect_set(variant))
    text = F.when(F.size("v") <= spelled, F.array_join("v", ", ")).otherwise(F.concat(F.size("v").cast("string"), F.lit(" variants")))
    return entries.groupBy(key).agg(v.alias("v"), F.max(strength).alias("_a"), F.min(strength).alias("_b")).select(F.col(key).alias("lineage"), F.size("v").cast("long").alias("n_variants"), text.alias("text"), (F.col("_a") / F.col("_b")).alias("fold"))
