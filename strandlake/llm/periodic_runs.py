"""Periodic runs of words by internal pattern matching.

A batch of texts becomes one sequence of numbered words in which equal words of different texts differ, so that sorting its suffixes
sorts each text's own. Prefix doubling sorts them; on its way it gives, for every power of two, the interval of the suffix array that
holds the occurrences of each dyadic block (the words from a multiple of the power, as many as the power). A wavelet tree over the
array answers range successors: how many of an interval's positions lie before the block, then which stand next to it on either
side. Occurrences of a block in the window of its own length beside it form a progression; its difference is the
candidate period. It is the least period of the stretch from the block to its neighbour, so of any run that holds them; a run of four
periods or more holds such a pair for the power that is its period or the next above it. Overlapping candidates of a period are
one; each is then extended word by word to both sides and kept if it is long enough.

The work is one map over the documents; nothing is shuffled. A text is searched whole, in one task: some two hundred bytes a word. Words are
told apart by 64-bit hashes. Null, empty and short texts have no run. Repeated rows are searched row by row; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.hashing import Words
from strandlake.llm.tables import bytes_of, map_texts


def suffixes_and_blocks(symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """Suffix array of sequences side by side (``at``: where each begins, and the end), which share no symbol; and for each power
    of two from 2 on (power, block starts, interval starts, interval ends) of the dyadic blocks that occur more than once."""
    n = len(symbols)
    size = np.diff(at)
    end, begin = np.repeat(at[1:], size), np.repeat(at[:-1], size)
    order = np.argsort(symbols, kind="stable")
    ordered = symbols[order]
    open_ = np.arange(n)
    rank = np.empty(n, np.int64)
    blocks = []

    def regroup(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank what stands at the open places by its ascending keys; which of them share a key, and up to where."""
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        count = np.diff(np.append(first, len(key)))
        rank[order[open_]] = np.repeat(open_[first], count)
        more = np.repeat(count > 1, count)
        return open_[more], np.repeat(open_[first] + count, count)[more]

    if n:
        open_, _ = regroup(ordered)
    step = 1
    while len(open_):
        here = order[open_]
        follow = here + step
        key = rank[here] * (n + 1) + np.where(follow < end[here], rank[np.minimum(follow, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        order[open_] = here[by]
        open_, stop = regroup(key[by])
        step *= 2
        here = order[open_]
        block = ((here - begin[here]) % step == 0) & (here + step <= end[here])
        if block.any():
            blocks.append((step, here[block], rank[here[block]], stop[block]))
    return order, blocks


class WaveletTree:
    """Counts and selections by value within intervals of an array, for many intervals at once."""

    def __init__(self, values: np.ndarray):
        self.levels = []
        for bit in reversed(range(int(values.max(initial=0)).bit_length() or 1)):
            one = (values >> bit & 1).astype(bool)
            zeros = np.append(0, np.cumsum(~one))
            self.levels.append((bit, zeros))
            values = np.concatenate([values[~one], values[one]])

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of each interval are less than ``x``, a value that the array has."""
        total = np.zeros(len(lo), np.int64)
        for bit, zeros in self.levels:
            a, b = zeros[lo], zeros[hi]
            one = (x >> bit & 1).astype(bool)
            total += np.where(one, b - a, 0)
            lo, hi = np.where(one, zeros[-1] + lo - a, a), np.where(one, zeros[-1] + hi - b, b)
        return total

    def nth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of rank ``k`` (from 0) in each interval."""
        value = np.zeros(len(lo), np.int64)
        for bit, zeros in self.levels:
            a, b = zeros[lo], zeros[hi]
            one = k >= b - a
            value |= one.astype(np.int64) << bit
            k = np.where(one, k - (b - a), k)
            lo, hi = np.where(one, zeros[-1] + lo - a, a), np.where(one, zeros[-1] + hi - b, b)
        return value


def candidates(symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of stretches made of a block and its nearest other occurrence, overlapping ones of a period as one."""
    order, blocks = suffixes_and_blocks(symbols, at)
    found = []
    if blocks:
        # the tree holds only suffixes that an interval holds
        edge = np.zeros(len(order) + 1, np.int64)
        for _, _, lo, hi in blocks:
            np.add.at(edge, lo, 1)
            np.add.at(edge, hi, -1)
        held = np.cumsum(edge[:-1]) > 0
        place = np.append(0, np.cumsum(held))
        tree = WaveletTree(order[held])
        for step, block, lo, hi in blocks:
            lo, hi = place[lo], place[hi]
            before = tree.below(lo, hi, block)
            for k, sign in ((before + 1, 1), (before - 1, -1)):
                some = (k >= 0) & (k < hi - lo)
                other, own = tree.nth(lo[some], hi[some], k[some]), block[some]
                period = sign * (other - own)
                near = period <= step
                period, first = period[near], np.minimum(own, other)[near]
                found.append((first, first + step + period, period))
    if not sum(len(start) for start, _, _ in found):
        none = np.empty(0, np.int64)
        return none, none, none
    start, stop, period = (np.concatenate(x) for x in zip(*found))
    by = np.lexsort((start, period))
    start, stop, period = start[by], stop[by], period[by]
    # a stretch that shares a period's length of words with those before it continues them
    n = len(symbols) + 1
    reach = np.maximum.accumulate(period * n + stop) - period * n
    new = np.ones(len(by), bool)
    new[1:] = (period[1:] != period[:-1]) | (start[1:] + period[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return start[first], reach[np.append(first[1:], len(by)) - 1], period[first]


def _matching(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common prefix."""
    n, done, width = min(len(a), len(b)), 0, 32
    while done < n:
        odd = np.flatnonzero(a[done : min(done + width, n)] != b[done : min(done + width, n)])
        if len(odd):
            return done + int(odd[0])
        done, width = done + width, 2 * width
    return n


def find_runs(symbols: np.ndarray, at: np.ndarray, exponent: int = 4, least: int = 6) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each sequence: stretches of at least ``exponent`` (4 or more) times their least period and at
    least ``least`` (6 or more) words that cannot be extended, by start and period."""
    if exponent < 4 or least < 6:
        raise ValueError("blocks find runs of four periods and six words or more")
    out: list[set] = [set() for _ in at[:-1]]
    start, stop, period = candidates(symbols, at)
    which = np.searchsorted(at, start, side="right") - 1
    for s, e, q, d in zip(start.tolist(), stop.tolist(), period.tolist(), which.tolist()):
        begin, end = int(at[d]), int(at[d + 1])
        e += _matching(symbols[e:end], symbols[e - q : end - q])
        s -= _matching(symbols[begin:s][::-1], symbols[begin + q : s + q][::-1])
        if e - s >= max(least, exponent * q):
            out[d].add((s - begin, e - s, q))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def runs_of(texts: list[bytes], exponent: int = 4, least: int = 6) -> tuple[list[int], list[list[tuple[int, int, int]]], list[bytes]]:
    """Of each text: number of words, runs, and the words outside repetitions joined by blanks."""
    words = Words(texts)
    at = words.at
    code, distinct = pd.factorize(words.hashes)
    symbols = np.repeat(np.arange(len(texts)) * max(1, len(distinct)), np.diff(at)) + code
    found = find_runs(symbols, at, exponent, least)
    kept = []
    for t, runs in zip(texts, found):
        parts = t.split()
        if runs:
            stay = np.ones(len(parts), bool)
            for s, n, q in runs:
                stay[s + q : s + n] = False
            parts = [parts[i] for i in np.flatnonzero(stay).tolist()]
        kept.append(b" ".join(parts))
    return np.diff(at).tolist(), found, kept


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = 4, least: int = 6) -> DataFrame:
    """(id, n_words, runs: array of start, length, period by start and period; collapsed: the text's words without those that a run holds
    after its first period, joined by one blank) of each row."""
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n, runs, kept = runs_of(bytes_of(b["text"]), exponent, least)
        listed = [[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in runs]
        return pa.RecordBatch.from_arrays([b["id"], pa.array(n, pa.int64()), pa.array(listed, pa.list_(struct)), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_texts(rows, run, f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string").withColumnRenamed("id", id_col)


def with_planted_tail(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) in which every tenth document by the checksum of its decimal identifier ends periodically: from word a on, its words are
    those from a to a + p - 1 again and again (a and p from the checksum and the number of words). A row without an identifier stays as it is."""
    words = F.col("_words")
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), h.alias("_h"), F.floor(h / 10).cast("long").alias("_g"))
    picked = rows.withColumn("_words", F.when((F.col("_h") % 10 == 0) & F.col("_text").isNotNull(), F.regexp_extract_all("_text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))))
    n, g = F.size(words).cast("long"), F.col("_g")
    placed = picked.withColumn("_a", F.when(n > 0, g % n)).withColumn("_p", F.when(n > 0, 1 + F.floor((n - F.col("_a")) / (3 + g % 8)).cast("long")))
    a, p = F.col("_a"), F.col("_p")
    again = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
    return placed.select(F.col("_id").alias(id_col), F.when(a.isNotNull(), F.array_join(again, " ")).otherwise(F.col("_text")).alias(text_col))
