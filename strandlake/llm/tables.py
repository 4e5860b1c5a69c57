"""Small helpers for Arrow batches inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from strandlake.session import ship


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """A string column as a list; a null is an empty text."""
    return pc.fill_null(column, "").to_pylist()


def bytes_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """A string or binary column as a list of byte strings; a null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def loose(kind: T.DataType) -> T.DataType:
    """The type with all fields of structs nullable, as Arrow tables that come back from tasks are held against."""
    return T.StructType([T.StructField(f.name, loose(f.dataType)) for f in kind]) if isinstance(kind, T.StructType) else kind


_LIBC = ctypes.CDLL(None)


def give_back() -> None:
    """Return freed memory to the system: workers are reused, and what one task has needed would stay with its process."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of the text column, or one row."""
    for b in batches:
        if not b.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(b[text]), 0).to_numpy(zero_copy_only=False).cumsum()
        start = 0
        while start < b.num_rows:
            base = size[start - 1] if start else 0
            end = max(start + 1, int(size.searchsorted(base + most, side="right")))
            yield b.slice(start, end - start)
            start = end
    give_back()


def map_texts(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text: str = "text") -> DataFrame:
    """``mapInArrow`` over batches of bounded text size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            yield fn(b)

    return df.mapInArrow(run, schema)
