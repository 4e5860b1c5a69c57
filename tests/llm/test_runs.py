"""Periodic runs against brute force, and the parts of the search by themselves."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from strandlake.llm import periodic_runs
from strandlake.llm.queries import op12_periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, exponent=4, least=6):
    n, out = len(w), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if j > i and e - s >= max(least, exponent * q) and all(w[s : e - p] != w[s + p : e] for p in range(1, q)):
                out.append((s, e - s, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def sample(rng):
    letters = "abcde"[: rng.choice([1, 2, 2, 3, 5])]
    out = []
    for _ in range(rng.randint(0, 6)):
        unit = [rng.choice(letters) for _ in range(rng.randint(1, 9))]
        out += unit * rng.randint(1, 7) + unit[: rng.randint(0, len(unit))] if rng.random() < 0.6 else [rng.choice(letters) for _ in range(rng.randint(0, 20))]
    return " ".join(out)


def test_runs_equal_brute_force():
    rng = random.Random(2)
    texts = [sample(rng) for _ in range(1500)]
    n, found, kept = periodic_runs.runs_of([t.encode() for t in texts])
    assert n == [len(t.split()) for t in texts]
    assert found == [brute(t.split()) for t in texts]
    assert [k.decode() for k in kept] == [collapsed(t.split(), r) for t, r in zip(texts, found)]
    assert sum(map(len, found)) > 300
    _, longer, _ = periodic_runs.runs_of([t.encode() for t in texts], exponent=5, least=9)
    assert longer == [brute(t.split(), 5, 9) for t in texts]
    with pytest.raises(ValueError):
        periodic_runs.find_runs(np.zeros(8, np.int64), np.array([0, 8]), exponent=3)


def test_suffix_array_and_tree():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 3, n) + 10 * k for k, n in enumerate((0, 1, 40, 7, 64))]
    symbols, at = np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))
    order, blocks = periodic_runs.suffixes_and_blocks(symbols, at)
    end = np.repeat(at[1:], np.diff(at))
    tails = [tuple(symbols[i : end[i]]) for i in range(len(symbols))]
    assert [tails[i] for i in order] == sorted(tails)
    for step, block, lo, hi in blocks:
        for b, a, z in zip(block, lo, hi):
            assert sorted(order[a:z]) == [i for i in range(len(symbols)) if tails[i][:step] == tails[b][:step]]
    values = rng.permutation(200)
    tree = periodic_runs.WaveletTree(values)
    lo = rng.integers(0, 150, 60)
    hi = lo + rng.integers(1, 50, 60)
    x = values[lo]
    below = tree.below(lo, hi, x)
    assert below.tolist() == [(values[a:b] < v).sum() for a, b, v in zip(lo, hi, x)]
    assert tree.nth(lo, hi, below).tolist() == x.tolist()


def test_long_texts():
    words = [b"w%d" % (i % 5000) for i in range(200_000)]
    _, found, kept = periodic_runs.runs_of([b"a " * 200_000, b" ".join(words), b""])
    assert found == [[(0, 200_000, 1)], [(0, 200_000, 5000)], []]
    assert kept == [b"a", b" ".join(words[:5000]), b""]


def test_documents(docs, nothing, corpus):
    got = {r.doc_id: r for r in periodic_runs.periodic_runs(docs).collect()}
    for i, t in corpus:
        w = WORD.findall(t or "")
        if len(w) < 2000:
            runs = brute(w)
            assert (got[i].n_words, [tuple(r) for r in got[i].runs], got[i].collapsed) == (len(w), runs, collapsed(w, runs))
    assert periodic_runs.periodic_runs(nothing).collect() == []


def test_query(spark, tmp_path):
    """The whole query with planted tails, nulls, repeats and columns that clash."""
    rng = random.Random(8)
    rows = [(i, sample(rng) if i % 7 else " ".join(rng.choice("abcdefgh") for _ in range(i % 90))) for i in range(400)]
    rows += [(401, None), (402, ""), (403, " \n"), (3, "again a b"), (3, "again a b"), (None, "a a a a a a"), (-5, "x")]
    spark.createDataFrame([(a, b, 1, "r", 2) for a, b in rows], "doc_id long, text string, _words int, runs string, start int").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, t in rows:
        w = WORD.findall(t or "")
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        runs = brute(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join("%d,%d,%d\n" % r for r in runs), collapsed(w, runs))]
        want.append((i, len(runs), *row, *sha))
    got = [tuple(r) for r in op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
