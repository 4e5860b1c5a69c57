"""Corpus-wide counts of 64-bit keys without a row per key.

Documents are dealt into blocks of a few megabytes of text. A task makes its block's distinct keys with their counts,
sorted, and sends each range of keys as one packed row: pre-aggregated, differences instead of keys, bytes of equal weight
side by side, so a key costs about five bytes. The task of a key range adds the counts up and answers every block with one
byte per key, the total up to 255. A key that a third of all documents share is thus one entry per block, never one per
document, and no task holds more than its range. The block's keys are made again when the answers arrive: they are a
function of the block's rows, in whatever order these come.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strandlake.llm.tables import give_back

#: Bytes of text in a block, and keys of a range, unless the caller says otherwise: a task needs some fifty times a block. Packed
#: rows are blocks x ranges, but never more than keys, and as long as a row holds hundreds of keys its overhead is small; for
#: corpora of many terabytes raise both with the executors' memory.
BLOCK_BYTES = 6_000_000
RANGE_KEYS = 3_000_000


def pack(keys: np.ndarray) -> bytes:
    """Ascending keys as planes of their differences' bytes."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def into_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int | None = None) -> tuple[DataFrame, int]:
    """Rows (block, id, text), and the bytes of all texts."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("n")).first()["n"]
    n = max(1, round(size / (block_bytes or BLOCK_BYTES)))
    # texts are dealt by identifier and content: equal identifiers do not gather
    block = F.pmod(F.xxhash64(id_col, text_col), F.lit(n)).cast("int")
    rows = docs.select(block.alias("block"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.repartition(n, "block"), size


def with_totals(
    rows: DataFrame,
    size: int,
    keys_of: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]],
    answer: Callable[[pa.Table, np.ndarray, np.ndarray], pa.Table],
    schema: StructType,
    range_keys: int | None = None,
) -> DataFrame:
    """Apply ``answer(block, keys, totals)`` to every block of ``rows``.

    ``keys_of(block)``: ascending distinct keys and their counts in the block; it must not depend on the order of rows.
    ``totals``: the count of each key over all blocks, 255 standing for 255 and more."""
    ranges = max(1, round(size / 6 / (range_keys or RANGE_KEYS)))  # a word and its gap are some six bytes

    def send(t: pa.Table) -> pa.Table:
        give_back()
        keys, counts = keys_of(t)
        # ranges of equal width: keys are hashes
        number = (keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
        at = np.searchsorted(number, np.arange(ranges + 1))
        full = [r for r in range(ranges) if at[r] < at[r + 1]]
        return pa.table(
            {
                "range": pa.array(full, pa.int32()),
                "block": pa.array([t["block"][0].as_py()] * len(full), pa.int32()),
                "keys": pa.array([pack(keys[at[r] : at[r + 1]]) for r in full], pa.binary()),
                "counts": pa.array([np.minimum(counts[at[r] : at[r + 1]], 255).astype(np.uint8).tobytes() for r in full], pa.binary()),
            }
        )

    def add(t: pa.Table) -> pa.Table:
        keys = [unpack(x) for x in t["keys"].to_pylist()]
        counts = np.frombuffer(b"".join(t["counts"].to_pylist()), np.uint8)
        flat = np.concatenate(keys)
        order = np.argsort(flat)
        ordered = flat[order]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        total = np.minimum(np.add.reduceat(counts[order].astype(np.int64), first), 255).astype(np.uint8)
        out = np.empty(len(flat), np.uint8)
        out[order] = np.repeat(total, np.diff(np.append(first, len(flat))))
        ends = np.cumsum([len(k) for k in keys])
        del keys, flat, order, ordered, counts
        give_back()
        return pa.table({"range": t["range"], "block": t["block"], "totals": pa.array([x.tobytes() for x in np.split(out, ends[:-1])], pa.binary())})

    def meet(t: pa.Table, totals: pa.Table) -> pa.Table:
        if not t.num_rows:
            return arrow.empty_table()
        keys, _ = keys_of(t)
        give_back()
        parts = dict(zip(totals["range"].to_pylist(), totals["totals"].to_pylist()))
        return answer(t, keys, np.frombuffer(b"".join(parts[r] for r in sorted(parts)), np.uint8)).cast(arrow)

    arrow = to_arrow_schema(schema)
    sent = rows.groupBy("block").applyInArrow(send, "range int, block int, keys binary, counts binary")
    added = sent.groupBy("range").applyInArrow(add, "range int, block int, totals binary")
    return rows.groupBy("block").cogroup(added.groupBy("block")).applyInArrow(meet, schema)
