"""Window keys and corpus-wide counts when the corpus is cut into many blocks of unequal size."""

import random

import numpy as np
import pytest
from test_documents import brute_components, brute_removals, rows

from strandlake.llm import blocks, ngram_join, substring_dedup
from strandlake.llm.hashing import Words


@pytest.fixture(scope="module")
def spread():
    """Copies, near copies and one shared passage, among texts of very different lengths."""
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    base, passage = words(120), words(50)
    texts = [words(rng.choice([5, 60, 300, 900])) for _ in range(40)]
    texts += [base] * 6 + [base[:k] + ["changed"] + base[k + 1 :] for k in range(10, 110, 10)]
    texts += [words(rng.randrange(20, 200)) + passage + words(rng.randrange(20, 200)) for _ in range(8)]
    return list(enumerate(map(" ".join, texts)))


@pytest.fixture
def cut(spark, spread, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(blocks, "RANGE_KEYS", 2000)
    docs = spark.createDataFrame(spread, "doc_id long, text string")
    sizes = [r["count"] for r in blocks.into_blocks(docs, "doc_id", "text")[0].groupBy("block").count().collect()]
    assert len(sizes) > 10 and len(set(sizes)) > 1
    return docs


def test_a_window_hash_is_a_function_of_its_words():
    text = b"one two three four five six"
    alone = Words([text]).windows(4)[0]
    for before, behind in ([b""], [b"x"]), ([b"x y z"], []), ([b"a " * 70], [b"b", b"c d e f g"]):
        words = Words([*before, text, *behind])
        keys, first = words.windows(4)
        begin = words.at[len(before)]
        assert np.array_equal(keys[(first >= begin) & (first < begin + 3)], alone)


def test_substring_dedup_over_many_blocks(cut, spread):
    got = rows(substring_dedup.removals(cut), "doc_id", "n_words", "n_removed", "kept_sha256")
    want = {i: v[:3] for i, v in brute_removals(spread, 35).items()}
    assert sum(v[1] > 0 for v in want.values()) == 24
    assert got == want


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_ngram_join_over_many_blocks(cut, spread, n, percent):
    got = rows(ngram_join.link_components(cut, n, percent), "doc_id", "n_shingles", "component_id")
    want = brute_components(spread, n, percent)
    assert sum(i != c for i, (_, c) in want.items()) >= 15
    assert got == want


def test_a_chain_of_links_in_large_groups(spark):
    """Each text links with the next two only: most links lie between blocks, and join components that the first round left apart."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(260)]
    texts = [" ".join(words[3 * k : 3 * k + 100]) for k in range(40)] + [" ".join(words[k : k + 60]) for k in (150, 190)]
    corpus = list(enumerate(texts))
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    got = rows(ngram_join.link_components(docs, group=3), "doc_id", "n_shingles", "component_id")
    assert got == brute_components(corpus, 4, 85)
    assert len({c for _, c in got.values()}) == 3


def test_labels_merge(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (5, 4), (4, 4), (9, 8), (8, 8)], "node long, label long")
    edges = spark.createDataFrame([(2, 5), (5, 20), (30, 31), (4, 4)], "src long, dst long")
    got = rows(ngram_join._merged(labels, edges), "node", "label")
    assert got == {k: (1,) for k in (1, 2, 4, 5, 20)} | {8: (8,), 9: (8,), 30: (30,), 31: (30,)}
