"""Best-fit-decreasing packing of token sequences.

A document is its ids and a closing id; longer ones than a sequence are cut into full pieces and a rest. Texts are encoded
in one map that leaves only a piece's place, length and checksum. Packing needs no more than how many pieces there are of each length, at most one number per possible
length: best fit in decreasing length runs over these counts. A segment tree over the remaining capacities finds the tightest open sequences that fit in logarithmic time; as equal
lengths follow each other, a run of equal sequences is filled in one step. What comes out is a list of ranges: the pieces of a length from this rank on go into the sequences from
that number on. All pieces of the corpus are packed together, whatever their number.

Ranks are counted without gathering a length: each bucket (what one task wrote) counts its lengths, running sums over the buckets give where its ranks begin, and its task
numbers its own rows and looks their ranges up.

Null is the empty text: one piece holding the closing id. Repeated rows are packed row by row.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.bpe import encoder
from strandlake.llm.tables import map_texts, texts_of
from strandlake.session import materialize


class OpenBins:
    """Runs of open bins (first bin, number) by remaining capacity, under a segment tree of which capacities have any."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()  # leaves 0..capacity
        self.any = [0] * (2 * self.size)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def put(self, left: int, first: int, number: int) -> None:
        self.runs[left].append((first, number))
        i = self.size + left
        while i:
            self.any[i] += 1
            i >>= 1

    def tightest(self, need: int) -> tuple[int, int, int] | None:
        """Take a run of bins with the least remaining capacity of at least ``need``: (capacity, first bin, number)."""
        i, tree = self.size + need, self.any
        while not tree[i]:  # climb until something lies to the right, and step over to it
            while i & 1:
                i >>= 1
            if i == 0:
                return None
            i += 1
        while i < self.size:
            i = 2 * i if tree[2 * i] else 2 * i + 1
        left = i - self.size
        run = self.runs[left].pop()
        while i:
            tree[i] -= 1
            i >>= 1
        return left, *run


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, rank, bin, in one bin, offset), ascending: from this rank on, the pieces of the length go into the bins from this one on, so many into each, the
    first at this offset. ``counts``: pieces of each length.

    A piece goes into the tightest bin that it fits. That bin is then tighter still, so it takes pieces of the length until none fits, and the next bin of
    its capacity does the same: all bins of a run are filled at once."""
    out, opened, bins = [], 0, OpenBins(capacity)
    for length in sorted(counts, reverse=True):
        rank, rest = 0, counts[length]
        while rest:
            found = bins.tightest(length)
            left, first, number = found or (capacity, opened, rest)
            each = left // length
            full = min(number, rest // each)
            used = full + (full < number and rest > full * each)
            out.append((length, rank, first, each, capacity - left))
            if full and left > each * length:
                bins.put(left - each * length, first, full)
            if used > full:  # the last bin takes what remains
                bins.put(left - (rest - full * each) * length, first + full, 1)
            placed = min(rest, used * each)
            rank, rest = rank + placed, rest - placed
            if found is None:
                opened += used
            elif number > used:
                bins.put(left, first + used, number - used)
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def place(plan: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of pieces by length and rank."""
    key = plan[:, 0] << 40 | plan[:, 1]
    row = plan[np.searchsorted(key, length << 40 | rank, side="right") - 1]
    inside = rank - row[:, 1]
    return row[:, 2] + inside // row[:, 3], row[:, 4] + inside % row[:, 3] * length


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of each document's pieces."""

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        row, piece, start, length, crc = [], [], [], [], []
        end = np.array([end_id], "<u4")
        for i, ids in enumerate(encoder(tokenizer).encode(texts_of(b["text"]))):
            ids = np.concatenate([ids, end])
            for k, at in enumerate(range(0, len(ids), capacity)):
                part = ids[at : at + capacity]
                row.append(i)
                piece.append(k)
                start.append(at)
                length.append(len(part))
                crc.append(zlib.crc32(part.tobytes()))
        return pa.RecordBatch.from_arrays(
            [b["id"].take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
            ["id", "piece", "start", "length", "ids_crc32"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_texts(rows, cut, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(cut: DataFrame, capacity: int = 4096) -> DataFrame:
    """Add sequence_id and offset to rows with a length from 1 to ``capacity``."""
    rows = materialize(cut.withColumn("_n", F.monotonically_increasing_id()), "pieces").withColumn("_bucket", F.shiftright("_n", 33).cast("int"))
    counts = materialize(rows.groupBy("length", "_bucket").agg(F.count("*").alias("n")), "lengths")
    of_length = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row per possible length at most
    if any(not 1 <= n <= capacity for n in of_length):
        raise ValueError(f"lengths from 1 to {capacity} can be packed")
    plan = best_fit_decreasing(of_length, capacity)
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_bucket", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    def fit(t: pa.Table, first: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "ascending"), ("_n", "ascending")])
        length = t["length"].to_numpy()
        new = np.flatnonzero(np.append(True, length[1:] != length[:-1])) if len(length) else np.empty(0, np.int64)
        own = np.arange(len(length)) - np.repeat(new, np.diff(np.append(new, len(length))))
        first = first.sort_by("length")
        rank = own + first["first"].to_numpy()[np.searchsorted(first["length"].to_numpy(), length)]
        bin_, offset = place(plan, length, rank)
        return t.drop_columns(["_n", "_bucket"]).append_column("sequence_id", pa.array(bin_)).append_column("offset", pa.array(offset))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return rows.groupBy("_bucket").cogroup(starts.groupBy("_bucket")).applyInArrow(fit, schema)
