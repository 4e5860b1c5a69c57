"""Mask search against brute force: every way of dealing items, ties, repeats, nulls and clashing columns."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from strandlake.llm import mask_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, k):
    counted = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, length = sum(n > 0 for _, _, n in counted), sum(n for _, _, n in counted)
    df = Counter(w for _, c, _ in counted for w in c)
    out = []
    for item, text in items:
        want = set(terms(text))
        scored = []
        for i, c, n in counted:
            m = 100 - 50 + (50 * n * n_docs) // max(length, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in want if w in c)
            if s > 0:
                scored.append((-s, math.inf if i is None else i))
        out += [(item, r + 1, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items(spark, corpus):
    words = [t for _, t in corpus if t]
    rows = [(0, "the river Stone"), (1, None), (2, ""), (3, "%% --"), (4, "nothingmatches"), (5, words[8][:700]), (5, "x9 12 日本 über"), (6, "the river Stone"), (7, words[12]), (None, "lamp")]
    return spark.createDataFrame([(a, b, 1, "z") for a, b in rows], "item_id long, text string, doc_id int, score string"), rows


@pytest.mark.parametrize("options", [{}, {"k": 3}, {"block_terms": 5}, {"most_terms": 0, "block_terms": 7}, {"most_terms": 0, "k": 1}])
def test_equals_brute_force(docs, corpus, items, options):
    got = mask_search.search(docs, items[0], **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(corpus, items[1], options.get("k", 50))


def test_repeated_and_unnamed_documents(spark, items):
    rows = [(1, "river river lamp"), (1, "river river lamp"), (None, "river river lamp"), (0, "river river lamp"), (2, "the"), (3, None), (4, "stone " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for k in (1, 2, 50):
        assert sorted(map(tuple, mask_search.search(docs, items[0], k=k).collect()), key=str) == brute(rows, items[1], k)


def test_empty_tables(nothing, docs, items):
    assert mask_search.search(nothing, items[0]).collect() == []
    assert mask_search.search(docs, items[0].where("item_id < 0")).collect() == []


def test_masks_end_the_search_early():
    """Of documents with few and common matches most are never scored, and the best are still right."""
    rng = np.random.default_rng(4)
    texts = [b" ".join(b"w%d" % w for w in rng.zipf(1.3, 80) % 3000) for _ in range(1500)]
    row = dict(zip(("n_docs", "n_terms", "ids", "sizes", "terms", "at", "docs", "counts"), mask_search.index_block(np.arange(1500), texts, None)))
    block = mask_search.Block(row, row["n_docs"], row["n_terms"])
    df = dict(zip(block.terms.tolist(), np.diff(block.at).tolist()))
    asked = np.unique(mask_search.terms_of([b" ".join(texts[7].split()[:25])])[0])
    weights = np.array([math.floor(1000 * math.log(3002 / (2 * df[t] + 1))) for t in asked.tolist()])
    none = np.empty(0, np.int64)
    everything, ids, scored = block.best(mask_search.Item(0, asked, weights), 1500, none, none)
    assert scored == len(ids)
    some, top, scored = block.best(mask_search.Item(0, asked, weights), 10, none, none)
    assert (some == everything[:10]).all() and (top == ids[:10]).all()
    assert scored < len(ids) / 2
