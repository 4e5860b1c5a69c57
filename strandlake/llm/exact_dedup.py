"""Exact duplicates by content sort.

Sampled splitters range-partition the rows by the texts' bytes (a prefix, then a 64-bit hash of the whole text), so the
splitters stay small however long the texts are; Spark's external sort then places equal texts next to each other, and a
streaming pass compares each whole text with its neighbour. The identifier is the last sort key, the one that stays first, so a
text that a third of all rows share is cut over several partitions. Groups are labelled in the pass that finds them. Only
runs at a partition's edge can go on in the next partition: these alone, a few rows a partition, are joined by digest.

Null is equal to the empty text. Ties fall to the largest identifier, or with ``keep="min"`` to the smallest; a null identifier
stays only if its group has no other. Of rows repeated with identifier and text one stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from strandlake.llm.tables import slices
from strandlake.session import materialize

PREFIX = 24


def _content_sorted(docs: DataFrame, text: Column, id_col: str, keep: str, payload: Column) -> DataFrame:
    """(payload, text, _hash, _part): equal texts adjacent, the row that stays first."""
    order = F.col("_id").desc_nulls_last() if keep == "max" else F.col("_id").asc_nulls_last()
    rows = docs.select(payload.alias("row"), text.alias("text"), F.col(id_col).alias("_id")).withColumn("_hash", F.xxhash64("text"))
    key = [F.substring("text", 1, PREFIX), F.col("_hash")]
    placed = rows.repartitionByRange(*key, order).sortWithinPartitions(*key, "text", order)
    return placed.select("row", "text", "_hash", F.spark_partition_id().alias("_part"))


def _runs(b: pa.RecordBatch, before: bytes | None) -> tuple[np.ndarray, bool]:
    """Where runs of equal texts begin in the batch, and whether its first row continues the text ``before``."""
    text = b["text"].cast(pa.large_binary())
    same = pc.equal(text[1:], text[:-1]).to_numpy(zero_copy_only=False)
    goes_on = before is not None and text[0].as_py() == before
    return np.flatnonzero(np.append(True, ~same)), goes_on


def _sha(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


class _Labels:
    """Labels of the runs of one partition, in its order. A group is the runs of one hash; the first and the last group are edges."""

    def __init__(self):
        self.before = self.first = self.hash = None
        self.group: list[list] = []  # runs of the current group: digest, arrays of ids, length, whether its first row is out
        self.out: list[tuple] = []

    def put(self, b: pa.RecordBatch) -> None:
        at, goes_on = _runs(b, self.before)
        ends = np.append(at[1:], b.num_rows).tolist()
        for k, (i, j) in enumerate(zip(at.tolist(), ends)):
            if k or not goes_on:
                h = b["_hash"][i].as_py()
                if h != self.hash:
                    self.close(self.hash == self.first)
                    self.hash = h
                    if self.first is None:
                        self.first = h
                self.before = (b["text"][i].as_py() or "").encode()
                self.group.append([_sha(self.before), [], 0, False])
            run = self.group[-1]
            run[1].append(b["row"].slice(i, j - i))
            run[2] += j - i
        if self.hash == self.first:
            self.flush(True)  # known to be an edge: a hot text is not held

    def close(self, edge: bool) -> None:
        self.flush(edge)
        if edge:
            for digest, _, n, _ in self.group:
                self.out.append((digest, None, n, False, True, None))  # the run's summary
        self.group = []

    def flush(self, edge: bool) -> None:
        for run in self.group:
            digest, ids, n, begun = run
            if ids:
                self.out.append((digest, pa.concat_arrays(ids), n, not begun, edge, None))
                run[1], run[3] = [], True

    def take(self, part: int, kind: pa.DataType) -> pa.RecordBatch:
        """The rows that are ready. Edge rows lack keep_id and group_size; a summary has a run's length and no row."""
        id_, digest, keep, size, kept, edge, run = [], [], [], [], [], [], []
        for d, ids, n, leads, e, _ in self.out:
            m = 1 if ids is None else len(ids)
            id_.append(pa.nulls(1, kind) if ids is None else ids)
            digest += [d] * m
            keep.append(pa.nulls(m, kind) if e else pa.concat_arrays([ids[:1]] * m) if m < 3 else ids.take(pa.array(np.zeros(m, np.int64))))
            size += [None if e else n] * m
            kept += [leads] + [False] * (m - 1)
            edge += [e] * m
            run += [n if ids is None else None] * m
        self.out = []
        arrays = [pa.concat_arrays(id_), pa.array(digest, pa.string()), pa.concat_arrays(keep)] if id_ else [pa.nulls(0, kind), pa.nulls(0, pa.string()), pa.nulls(0, kind)]
        rest = [pa.array(size, pa.int64()), pa.array(kept, pa.bool_()), pa.array(edge, pa.bool_()), pa.array(run, pa.int64()), pa.array([part] * len(size), pa.int32())]
        return pa.RecordBatch.from_arrays(arrays + rest, ["id", "text_sha256", "keep_id", "group_size", "kept", "edge", "run", "part"])


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    labels, part, kind = _Labels(), None, None
    for b in slices(batches, "text"):
        part, kind = b["_part"][0].as_py(), b["row"].type
        labels.put(b)
        yield labels.take(part, kind)
    if part is not None:
        labels.close(True)
        yield labels.take(part, kind)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", normalise: Column | None = None) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of each row. ``normalise``: the text to compare (default: unchanged)."""
    text = F.coalesce(F.col(text_col) if normalise is None else normalise, F.lit(""))
    kind = docs.schema[id_col].dataType
    fields = [("id", kind), ("text_sha256", StringType()), ("keep_id", kind), ("group_size", LongType()), ("kept", BooleanType()), ("edge", BooleanType()), ("run", LongType()), ("part", IntegerType())]
    schema = StructType([StructField(*f) for f in fields])
    rows = materialize(_content_sorted(docs, text, id_col, keep, F.col(id_col)).mapInArrow(_labelled, schema), "runs")
    inner = rows.where("NOT edge")
    edge = rows.where("edge AND run IS NULL")
    # a few rows a partition; the first part of a group holds the row that stays
    sums = rows.where("run IS NOT NULL").groupBy("text_sha256").agg(F.sum("run").alias("group_size"), F.min("part").alias("lead_part"))
    leads = edge.where("kept").select("text_sha256", "id", "part").join(sums, "text_sha256").where("part = lead_part").select("text_sha256", F.col("id").alias("keep_id"), "group_size", "lead_part")
    joined = edge.drop("keep_id", "group_size").join(leads, "text_sha256").withColumn("kept", F.expr("kept AND part = lead_part"))
    out = ["id", "keep_id", "group_size", "kept", "text_sha256"]
    return inner.select(out).union(joined.select(out)).withColumnRenamed("id", id_col)


def _leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each run. ``digest`` is set in the partition's first group, whose runs may have begun before it;
    a last row without content says for each run of the last group that it may go on behind."""
    before = first = hash_ = None
    texts: list[bytes] = []
    names = ["row", "text", "digest", "part", "mark"]
    part = kind = None
    for b in slices(batches, "text"):
        part, kind = b["_part"][0].as_py(), b["row"].type
        at, goes_on = _runs(b, before)
        at = at[1:] if goes_on else at
        digests = []
        for i in at.tolist():
            h, before = b["_hash"][i].as_py(), (b["text"][i].as_py() or "").encode()
            first = h if first is None else first
            if h != hash_:
                hash_, texts = h, []
            texts.append(before)
            digests.append(_sha(before) if h == first else None)
        take = pa.array(at)
        yield pa.RecordBatch.from_arrays(
            [b["row"].take(take), b["text"].take(take), pa.array(digests, pa.string()), pa.array([part] * len(at), pa.int32()), pa.array([False] * len(at), pa.bool_())], names
        )
    if part is not None and hash_ != first:
        n = len(texts)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(n, kind), pa.nulls(n, pa.string()), pa.array(list(map(_sha, texts)), pa.string()), pa.array([part] * n, pa.int32()), pa.array([True] * n, pa.bool_())], names
        )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row of each group of equal texts, with all its columns. A null text comes back as null only if it leads its group."""
    others = [c for c in docs.columns if c != text_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    payload = F.struct(F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"), F.col(text_col).isNull().alias("null"))
    schema = StructType(
        [
            StructField("row", docs.select(payload.alias("row")).schema["row"].dataType),
            StructField("text", StringType()),
            StructField("digest", StringType()),
            StructField("part", IntegerType()),
            StructField("mark", BooleanType()),
        ]
    )
    rows = materialize(_content_sorted(docs, text, id_col, keep, payload).mapInArrow(_leaders, schema), "leaders")
    earliest = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("part").alias("lead_part"))
    doubtful = rows.where("digest IS NOT NULL AND NOT mark").join(earliest, "digest").where("part = lead_part")
    kept = rows.where("digest IS NULL").select("row", "text").union(doubtful.select("row", "text"))
    back = {c: F.when(~F.col("row.null"), F.col("text")) if c == text_col else F.col(f"row.row.`{c}`") for c in docs.columns}
    return kept.select(*(c.alias(name) for name, c in back.items()))
