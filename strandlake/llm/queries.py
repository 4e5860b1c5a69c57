"""The registered queries of this subpackage: one per operator, each over its whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import chunk_reuse, exact_dedup, html_text, licenses, mask_search, ngram_join, packing, periodic_runs, piece_spans, quality_rules, substring_dedup, token_counts, warc
from strandlake.llm.sql import ORACLES
from strandlake.llm.tables import read
from strandlake.session import shared_dir

VOCABULARY = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def vocabulary() -> str:
    return public_tokenizers.path(VOCABULARY)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), vocabulary())


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_warc(pages, path)
    return warc.read_warc(spark, path).select(
        F.col("name").try_cast("long").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_name").try_cast("long").alias("refers_to")
    )


def op3_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_reuse.encode(read(spark, sf_dir, "documents"), vocabulary(), digest=True)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(read(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_policy(quality_rules.ledger(read(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(read(spark, sf_dir, "documents"), vocabulary())).withColumnRenamed("id", "doc_id")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removals(read(spark, sf_dir, "documents")).drop("spans")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


def op11_mask_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs.periodic_runs(periodic_runs.with_planted_tail(read(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    length, start, period = longest.length, -longest.start, -longest.period
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_piece_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_spans.encode(read(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), digest=True)


QUERIES = {
    f.__name__: f
    for f in (op1_token_counts, op2_warc, op3_chunk_reuse, op4_ngram_join, op5_quality_rules, op6_best_fit_packing, op7_license_scan, op8_exact_dedup, op9_substring_dedup, op10_html_text, op11_mask_search, op12_periodic_runs, op13_piece_spans)
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
