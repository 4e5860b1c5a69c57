"""All queries of the library, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlake.queries import contact_queries, library_queries, motion_queries, profile_queries, ring_queries, series_queries, source_queries, structure_queries

ALL = ring_queries.R | profile_queries.R | source_queries.R | contact_queries.R | library_queries.R | series_queries.R | motion_queries.R | structure_queries.R


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ALL["a02_interaction_classes"].run(spark, sf_dir)


def queries() -> dict:
    return {n: q.run for n, q in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, q in ALL.items() if (s := q.oracle()) is not None}
