"""Repeated rows, identifiers that clash, and null identifiers in every stage that drops or changes rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_documents import brute_removals

from strandlake.llm import exact_dedup, ngram_join, quality_rules, substring_dedup
from strandlake.session import ship

LONG = " ".join(f"w{k * 7 % 61}x{k}" for k in range(80))
NEAR = LONG.replace("x40", "changed")
OTHER = " ".join(f"v{k * 5 % 53}y{k}" for k in range(90))
ROWS = [(1, LONG), (1, LONG), (2, NEAR), (3, OTHER), (3, LONG + " and more"), (None, OTHER), (None, OTHER + " end"), (4, None), (4, ""), (5, "short"), (5, "short")]
SCHEMA = "doc_id long, text string, lang string, n_words long, _row string, edge int"


@pytest.fixture(scope="module")
def rows(spark):
    ship(spark)
    return spark.createDataFrame([(i, t, "en", 9, None, 1) for i, t in ROWS], SCHEMA).repartition(4)


def texts(df):
    assert df.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    return Counter((r["doc_id"], r["text"] or "") for r in df.collect())


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_dedup_leaves_one_row_of_a_text(rows, keep):
    got = texts(exact_dedup.drop_exact(rows, keep=keep))
    want = {}
    for i, t in ROWS:
        t = t or ""
        old = want.get(t, "none")
        if old == "none" or old is None or i is not None and (i > old if keep == "max" else i < old):
            want[t] = i
    assert got == Counter((i, t) for t, i in want.items())
    groups = exact_dedup.exact_groups(rows, keep=keep).collect()
    assert len(groups) == len(ROWS) and sum(r["kept"] for r in groups) == len(want)
    size = Counter(t or "" for _, t in ROWS)
    assert Counter(r["group_size"] for r in groups) == Counter(size[t or ""] for _, t in ROWS)


def test_a_text_over_many_partitions(spark, rows, monkeypatch):
    """One text fills several ranges, others stand at their edges."""
    many = [(k, "hot") for k in range(600)] + [(1000 + k, f"text {k % 150}") for k in range(300)] + [(5000, "hot")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        df = spark.createDataFrame(many, "doc_id long, text string").repartition(5)
        got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(df).collect()}
        kept = {r["doc_id"] for r in exact_dedup.drop_exact(df).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    best, size = {}, Counter(t for _, t in many)
    for i, t in many:
        best[t] = max(i, best.get(t, -1))
    assert got == {i: (best[t], size[t], i == best[t]) for i, t in many}
    assert kept == set(best.values())


def test_near_dedup_leaves_one_row_of_a_component(rows):
    got = texts(ngram_join.drop_near(rows, 5, 80))
    # LONG, NEAR and LONG with more are one component, OTHER and OTHER with an end another, the empty texts stand alone
    linked = {LONG, NEAR, LONG + " and more"}
    assert sum(n for (_, t), n in got.items() if t in linked) == 1 and (1, LONG) in got
    assert sum(n for (_, t), n in got.items() if t.startswith(OTHER)) == 1
    assert got[(5, "short")] == 1 and got[(4, "")] == 1


def test_quality_keeps_and_drops_rows_by_themselves(rows):
    got = texts(quality_rules.drop_failed(rows))
    assert got == Counter((i, t) for i, t in ROWS if t and len(t.split()) >= 50)


def test_passages_keep_every_row(spark, rows):
    import corpus_pipeline

    got = texts(corpus_pipeline.passages(spark, rows.withColumnRenamed("n_words", "n_chars"), "").withColumnRenamed("n_chars", "n_words"))
    want = brute_removals(list(enumerate(t for _, t in ROWS)), 35)
    assert Counter((i, " ".join(t.split())) for i, t in got.elements()) == Counter((ROWS[k][0], v[3]) for k, v in want.items())
    assert substring_dedup.removals(rows).count() == len(ROWS)


#: names that operators use inside
INSIDE = "_key key _content content _row row _null null _hash hash text_ digest part mark id n n_shingles component_id component label node src dst kept keep_id group_size block fail_bits n_words kept_text spans _n _bucket length piece".split()


def test_stages_keep_columns_of_any_name(spark):
    """Each stage of the pipeline over a table whose other columns have the names used inside."""
    import corpus_pipeline

    ship(spark)
    rows = [(i, t, *range(len(INSIDE))) for i, t in ROWS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in INSIDE)).withColumn("n_chars", F.length("text").cast("long")).repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, "")
        assert got.columns == docs.columns, name
        kept = got.collect()
        assert kept and all([r[c] for c in INSIDE] == list(range(len(INSIDE))) for r in kept), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= len(rows)
