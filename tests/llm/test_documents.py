"""Operators over documents against brute force on a small corpus of edge cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from strandlake.llm import bpe, chunk_reuse, components, exact_dedup, licenses, ngram_join, packing, quality_rules, substring_dedup, token_counts
from strandlake.session import ship

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df, key, *cols):
    got = df.collect()
    out = {tuple(r[k] for k in key) if isinstance(key, tuple) else r[key]: tuple(r[c] for c in cols) for r in got}
    assert len(out) == len(got)
    return out


@pytest.fixture(scope="module")
def encoded(corpus, vocabulary):
    tok = Tokenizer.from_file(vocabulary)
    return {i: tok.encode(t or "", add_special_tokens=False).ids for i, t in corpus}, tok


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_token_counts(spark, docs, nothing, corpus, encoded, vocabulary):
    ship(spark)
    got = rows(token_counts.token_counts(docs, vocabulary), "doc_id", "n_bytes", "n_tokens", "over_limit")
    assert got == {i: (len((t or "").encode()), len(encoded[0][i]), len(encoded[0][i]) > 2048) for i, t in corpus}
    assert token_counts.token_counts(nothing, vocabulary).collect() == []


def test_merges_equal_the_library(vocabulary):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    tok, count, enc = Tokenizer.from_file(vocabulary), bpe.Counter(vocabulary), bpe.Encoder(vocabulary)

    @settings(max_examples=150, deadline=None)
    @given(st.text(st.characters(exclude_categories=("Cs",)), max_size=60) | st.text("abté'sl S\n 12!É<|>", max_size=60))
    def check(t):
        ids = tok.encode(t, add_special_tokens=False).ids
        assert count.count([t, t + " ", ""]).tolist() == [len(ids), len(ids), 0]
        assert enc.encode([t])[0].tolist() == ids
        assert enc.decode(np.array(ids, "<u4")).decode() == tok.decode(ids, skip_special_tokens=False)

    check()


def test_chunks_cover_and_recur(vocabulary):
    rng = np.random.default_rng(3)
    data = bytes(rng.integers(97, 123, 60_000, dtype=np.uint8))
    cut = chunk_reuse.chunks(data)
    assert b"".join(cut) == data and len(cut) > 5
    moved = chunk_reuse.chunks(b"prefix" + data)
    assert len(set(cut) & set(moved)) >= len(cut) - 2
    text = ("日本é" * 9000).encode()
    assert b"".join(chunk_reuse.chunks(text)) == text
    assert all(c.decode() for c in chunk_reuse.chunks(text))


def test_chunk_reuse(docs, nothing, corpus, encoded, vocabulary):
    got = rows(chunk_reuse.encode(docs, vocabulary), "doc_id", "n_tokens", "ids", "decoded")
    ids, tok = encoded
    assert got == {i: (len(ids[i]), ids[i], tok.decode(ids[i], skip_special_tokens=False)) for i, _ in corpus}
    hashed = rows(chunk_reuse.encode(docs, vocabulary, digest=True), "doc_id", "ids_sha256")
    assert hashed == {i: (hashlib.sha256(np.array(ids[i], "<u4").tobytes()).hexdigest(),) for i, _ in corpus}
    assert chunk_reuse.encode(nothing, vocabulary).collect() == []


def shingles(t, n):
    w = WORD.findall(lower(t))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(corpus, n, percent):
    sets = {i: shingles(t, n) for i, t in corpus}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("n,percent,group", [(4, 85, 300), (5, 80, 4)])
def test_ngram_join(docs, nothing, corpus, n, percent, group):
    got = rows(ngram_join.link_components(docs, n, percent, group=group), "doc_id", "n_shingles", "component_id")
    assert got == brute_components(corpus, n, percent)
    assert ngram_join.link_components(nothing).collect() == []


def test_divide_skip_finds_every_component():
    rng = np.random.default_rng(11)
    for _ in range(40):
        base = rng.integers(0, 1 << 60, 40, dtype=np.uint64)
        sets = []
        for _ in range(25):
            s = base.copy()
            k = rng.integers(0, 12)
            s[rng.integers(0, 40, k)] = rng.integers(0, 1 << 60, k, dtype=np.uint64)
            sets.append(np.unique(s))
        sets.sort(key=len)
        up = ngram_join.Forest(len(sets))
        for i in range(len(sets)):
            for j in range(i):
                o = len(np.intersect1d(sets[i], sets[j]))
                if 100 * o >= 85 * (len(sets[i]) + len(sets[j]) - o):
                    up.join(i, j)
        found = ngram_join.Forest(len(sets))
        for i, j in ngram_join.divide_skip(sets, 85):
            assert found.join(i, j)
        assert [up.root(i) for i in range(len(sets))] == [found.root(i) for i in range(len(sets))]


def test_divide_skip_across_two_sides():
    """One side is one component; what links to it, or is linked through it, is found with the fewest tests."""
    rng = np.random.default_rng(12)
    for _ in range(60):
        base = rng.integers(0, 1 << 60, 40, dtype=np.uint64)
        sets = []
        for _ in range(30):
            s = base.copy()
            k = rng.integers(0, 14)
            s[rng.integers(0, 40, k)] = rng.integers(0, 1 << 60, k, dtype=np.uint64)
            sets.append(np.unique(s)[rng.integers(0, 3) :])
        sets.sort(key=len)
        sides = [bool(x) for x in rng.integers(0, 2, 30)]
        known = ["whole" if s else str(rng.integers(0, 8)) for s in sides]
        linked = lambda i, j: 100 * len(o := np.intersect1d(sets[i], sets[j])) >= 85 * (len(sets[i]) + len(sets[j]) - len(o))
        up, found = ngram_join.Forest(30), ngram_join.Forest(30)
        for f in (up, found):
            for i in range(30):
                f.join(i, known.index(known[i]))
        for i in range(30):
            for j in range(i):
                if sides[i] != sides[j] and linked(i, j):
                    up.join(i, j)
        for i, j in ngram_join.divide_skip(sets, 85, known, sides):
            assert linked(i, j)
            found.join(i, j)
        assert [up.root(i) for i in range(30)] == [found.root(i) for i in range(30)]


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 201)]
    got = rows(components.components(spark.createDataFrame(edges, "src long, dst long")), "node", "label")
    assert got == {i: (0,) for i in range(31)} | {i: (100,) for i in range(100, 130)} | {200: (200,), 201: (200,)}


def brute_quality(t):
    t = t or ""
    w = WORD.findall(t)
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = set()
    for i in range(len(w) - 2):
        if c[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_quality_rules(docs, nothing, corpus):
    ledger = quality_rules.ledger(docs)
    got = rows(quality_rules.apply_policy(ledger), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == {i: brute_quality(t) for i, t in corpus}
    assert quality_rules.ledger(nothing).collect() == []


def test_ablations_agree_with_the_ledger(docs):
    ledger = quality_rules.ledger(docs)
    bits = [r["fail_bits"] for r in ledger.collect()]
    for r in quality_rules.ablations(ledger).collect():
        mask, bit = quality_rules.POLICIES[r["policy"]], 1 << next(x.bit for x in quality_rules.RULES if x.name == r["rule"])
        assert r["n_failed"] == sum(bool(b & bit) for b in bits)
        assert r["n_rejected"] == sum(bool(b & mask) for b in bits)
        assert r["n_only"] == sum((b & mask) == bit for b in bits)


def test_quality_rules_stay_native(docs):
    plan = quality_rules.ledger(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_packing(docs, nothing, corpus, encoded, vocabulary):
    want = {}
    for i, ids in encoded[0].items():
        ids = ids + [1]
        for k, s in enumerate(range(0, len(ids), 4096)):
            want[i, k] = (s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes()))
    packed = packing.pack(packing.pieces(docs, vocabulary))
    assert rows(packed, ("id", "piece"), "start", "length", "ids_crc32") == want
    bins = defaultdict(list)
    for r in packed.collect():
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(bins) == -(-sum(v[1] for v in want.values()) // 4096)
    assert packing.pack(packing.pieces(nothing, vocabulary)).collect() == []


def one_by_one(lengths, capacity):
    """Bins of best fit decreasing, piece after piece, by trying all open bins."""
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [x for x in left if x >= n]
        if fits:
            left.remove(min(fits))
            left.append(min(fits) - n)
        else:
            left.append(capacity - n)
    return sorted(left)


def test_best_fit_takes_the_tightest_bin():
    rng = np.random.default_rng(6)
    for trial in range(60):
        capacity = int(rng.integers(5, 80))
        lengths = rng.integers(1, capacity + 1, int(rng.integers(0, 300)))
        if trial % 3 == 0:
            lengths = np.repeat(lengths[:6], 30)
        counts = Counter(lengths.tolist())
        plan = packing.best_fit_decreasing(counts, capacity)
        length = np.array(sorted(counts.elements()), np.int64)
        rank = np.array([k for n in sorted(counts) for k in range(counts[n])], np.int64)
        if not len(length):
            assert not len(plan)
            continue
        bins, offset = packing.place(plan, length, rank)
        used = [0] * (int(bins.max()) + 1)
        for b, o, n in sorted(zip(bins.tolist(), offset.tolist(), length.tolist())):
            assert o == used[b]  # gapless
            used[b] += n
        assert sorted(capacity - u for u in used) == one_by_one(lengths.tolist(), capacity)


def test_packing_is_global(spark):
    """A quarter of a million pieces over many buckets, one length with a third of them: as many sequences as one best fit over all gives."""
    rng = np.random.default_rng(3)
    n = 240_000
    lengths = np.where(rng.random(n) < 1 / 3, 1500, rng.integers(1, 4096, n))
    path = [(int(k), 0, 0, int(v), 7) for k, v in enumerate(lengths)]
    df = spark.createDataFrame(__import__("pandas").DataFrame(path, columns=["id", "piece", "start", "length", "ids_crc32"])).repartition(40)
    got = packing.pack(df).toPandas()
    assert len(got) == n and sorted(got["id"]) == list(range(n)) and (lengths[got["id"]] == got["length"]).all()
    got = got.sort_values(["sequence_id", "offset"])
    ends = got.groupby("sequence_id")["length"].cumsum()
    assert ((ends - got["length"]) == got["offset"]).all() and ends.max() <= 4096
    opened = packing.OpenBins(4096)
    bins = 0
    for v in np.sort(lengths)[::-1].tolist():  # piece after piece
        found = opened.tightest(v)
        bins += found is None
        left = (found[0] if found else 4096) - v
        if left:
            opened.put(left, 0, 1)
    assert got["sequence_id"].nunique() == bins


def brute_license(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    hits = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(hits), min(hits)[0] if hits else None, max(hits)[0] if hits else None, ",".join(sorted({x for _, x in hits}))


def brute_templates(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    more, best = set(), 0.0
    for (label, words, need, half, _, _), every in zip(licenses._templates(licenses.TEMPLATES, 0.8), [t.split() for ts in licenses.TEMPLATES.values() for t in ts]):
        for k in range(0, len(w), half):
            block = w[k : k + 2 * half]
            n = len(set(block) & set(words))
            if len(words) < 10:
                ordered = any(block[i : i + len(every)] == every for i in range(len(block)))
            else:
                own = set(zip(every, every[1:]))
                ordered = len(own & set(zip(block, block[1:]))) >= 0.3 * len(own)
            if n >= need and ordered:
                more.add(label)
                best = max(best, n / len(words))
    return more, best


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
BSD = """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are met:
# 1. Redistributions of source code must retain the above copyright notice"""


@pytest.mark.parametrize("before", [0, 7, 63, 200])
def test_wrapped_licenses_in_long_texts(spark, before):
    filler = " ".join(f"word{k}" for k in range(before))
    one_line = "released early this year under the hood there is a license plate " * 30
    texts = [(1, f"{filler}\n{MIT}\n{filler}"), (2, f"{filler} {BSD}"), (2, one_line), (2, "released under the apache license"), (4, f"{filler} Licensed under the\nMIT license"), (None, MIT.upper())]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, row string, block int")
    got = sorted((str(r["doc_id"]), r["labels"], r["score"] > 0.99) for r in licenses.scan(df).collect())
    assert got == sorted([("1", "mit", True), ("2", "bsd", True), ("2", "", False), ("2", "", False), ("4", "mit", True), ("None", "mit", True)])
    where = {(r["label"], r["doc_id"]): (r["first_word"], r["block_words"]) for r in licenses.template_matches(df).collect() if r["doc_id"] == 1}
    assert all(at <= before + 66 and at + n >= before for at, n in where.values()) and where


def test_words_in_another_order_are_no_license(spark):
    rng = np.random.default_rng(4)
    cc0 = licenses.TEMPLATES["cc0"][0].split()
    edited = MIT.split()
    for k in rng.choice(len(edited), 9, replace=False):
        edited[k] = "changed"
    texts = ["the mit license was released under pressure in 1988 they say", " ".join(rng.permutation(cc0)), " ".join(rng.permutation(MIT.split())), " ".join(edited), "was released under the MIT License."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows(licenses.scan(df), "doc_id", "labels", "score")
    assert [got[i][0] for i in range(5)] == ["", "", "", "mit", "mit"] and got[1][1] == 0 and 0.8 <= got[3][1] < 1
    assert [brute_templates(t)[0] for t in texts] == [set(), set(), set(), {"mit"}, {"mit"}]


def test_license_scan(docs, nothing, corpus):
    got = rows(licenses.scan(docs), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert {i: v[:5] for i, v in got.items()} == {i: brute_license(t) for i, t in corpus}
    for i, t in corpus:
        more, best = brute_templates(t)
        base = set(filter(None, got[i][4].split(",")))
        assert got[i][5] == ",".join(sorted(base | more))
        assert got[i][6] == pytest.approx(1.0 if base else best)
    assert licenses.scan(nothing).collect() == []


def test_license_scan_stays_native(docs):
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_groups(docs, nothing, corpus, keep):
    groups = defaultdict(list)
    for i, t in corpus:
        groups[t or ""].append(i)
    best = max if keep == "max" else min
    got = rows(exact_dedup.exact_groups(docs, keep=keep), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == {i: (best(g), len(g), i == best(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    kept = exact_dedup.drop_exact(docs, keep=keep)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {best(g) for g in groups.values()}
    assert exact_dedup.exact_groups(nothing).collect() == []


def brute_removals(corpus, width):
    words = {i: WORD.findall(t or "") for i, t in corpus}
    n = Counter(tuple(w[k : k + width]) for w in words.values() for k in range(len(w) - width + 1))
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - width + 1):
            if n[tuple(w[k : k + width])] > 1:
                gone |= set(range(k, k + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


@pytest.mark.parametrize("width", [35, 5])
def test_substring_dedup(docs, nothing, corpus, width):
    got = rows(substring_dedup.removals(docs, width, texts=True), "doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "spans")
    want = brute_removals(corpus, width)
    assert {i: v[:3] for i, v in got.items()} == {i: v[:3] for i, v in want.items()}
    assert {i: " ".join(WORD.findall(v[3])) for i, v in got.items()} == {i: v[3] for i, v in want.items()}
    assert all(sum(e - s for s, e in v[4]) == v[1] and all(a[1] < b[0] for a, b in zip(v[4], v[4][1:])) for v in got.values())
    assert {i: got[i][3] for i, t in corpus if not got[i][1]} == {i: t or "" for i, t in corpus if not got[i][1]}
    assert substring_dedup.removals(nothing).collect() == []


def test_results_do_not_depend_on_partitions(docs):
    one, seven = (sorted(ngram_join.link_components(docs.repartition(k)).collect()) for k in (1, 7))
    assert one == seven
    one, seven = (sorted(map(str, substring_dedup.removals(docs.repartition(k)).collect())) for k in (1, 7))
    assert one == seven


def test_repeated_rows(docs, vocabulary):
    twice = docs.union(docs)
    n = docs.count()
    for df in (token_counts.token_counts(twice, vocabulary), ngram_join.link_components(twice), quality_rules.ledger(twice), exact_dedup.exact_groups(twice), substring_dedup.removals(twice), chunk_reuse.encode(twice, vocabulary)):
        assert df.count() == 2 * n
    assert packing.pack(packing.pieces(twice, vocabulary)).count() == 2 * packing.pieces(docs, vocabulary).count()
