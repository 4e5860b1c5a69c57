"""A corpus-cleaning pipeline over ``documents``: quality rules, exact and near duplicates, shared passages, packing.

Rows go through the stages whole, other columns under whatever name included; an empty table gives an empty one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import exact_dedup, ngram_join, packing, quality_rules, substring_dedup
from strandlake.llm.queries import vocabulary
from strandlake.session import materialize, ship

#: Near duplicates in the pipeline: five words to a shingle, similarity of 0.8 or more.
NEAR = {"n": 5, "percent": 80}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps. A null or empty text has no words and is dropped; repeated rows are judged row by row."""
    return quality_rules.drop_failed(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that of the largest identifier; of rows repeated whole, one. Null counts as empty, a null identifier yields to any other."""
    return exact_dedup.drop_exact(docs).select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest identifier; of rows repeated whole, one. Texts without words are linked with nothing and stay."""
    return ngram_join.drop_near(docs, **NEAR).select(docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that stand elsewhere too. A row's other columns go with its text: nothing is joined by identifier.
    A null or empty text stays, as an empty one; of a repeated row every copy loses what it shares."""
    carried = docs.select(F.struct(*(c for c in docs.columns if c != "text")).alias("_row"), "text")
    kept = substring_dedup.removals(carried, id_col="_row", texts=True).select("_row.*", F.col("kept_text").alias("text"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of what is left; a null or empty text is the closing id alone."""
    return packing.pack(packing.pieces(docs, vocabulary())).withColumnRenamed("id", "doc_id")


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("ngram_join", near), ("substring_dedup", passages), ("best_fit_packing", packed)]

#: Tokens have no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return materialize(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
