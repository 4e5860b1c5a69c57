"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of each node of (src, dst): label is the component's smallest node.

    Alternating stars: each round hooks every node's neighbours to its smallest one, first the larger neighbours, then
    the smaller ones; the rounds grow as the logarithm of the longest path. Each round's edges are written to the shared folder.
    A hub's edges are reduced by a partial minimum before they move."""
    now = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    now = materialize(now, "star")
    mark = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("a"), "u", "m")
        hooked = small.where("a <> m").select(F.col("a").alias("u"), F.col("m").alias("v")).union(lower.select("u", F.col("m").alias("v")))
        now = materialize(hooked.where("u <> v").distinct(), "star")
        new = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if tuple(new) == mark:
            break
        mark = tuple(new)
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
