"""Second moments of vectors as sums of partial matrices: no row per pair of components, and no key gathered in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

#: Numbers in one row of partial sums, and those a task may hold before it sends what it has.
_ROW, _HELD = 16_384, 16_000_000


def second_moments(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, first, n, sums, products) of each key's vectors of one length d: number of vectors, their sum, and some rows of their sum of outer
    products, flat, from row ``first``. Each task adds its own vectors up; what moves is a matrix a task and key."""
    kind = rows.schema[key].dataType

    def blocks(k, n: int, sums: np.ndarray, m: np.ndarray) -> Iterator[tuple]:
        step = max(1, _ROW // len(sums))
        for i in range(0, len(sums), step):
            yield k, i, n, sums, m[i : i + step].ravel()

    def table(out: list[tuple], k: pa.DataType) -> pa.RecordBatch:
        kinds = (k, pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], [key, "first", "n", "sums", "products"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        size, arrow = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            arrow, names = b[key].type, b[key].to_pylist()
            order = np.array(sorted(range(len(names)), key=lambda i: (names[i] is None, names[i])))
            size_of = pc.list_value_length(b[vector]).to_numpy(zero_copy_only=False)
            x, at = b[vector].flatten().to_numpy(zero_copy_only=False), np.cumsum(size_of) - size_of
            start = 0
            for end in range(1, len(order) + 1):
                k = names[order[start]]
                if end < len(order) and names[order[end]] == k:
                    continue
                rows_of = order[start:end]
                part, start = x[at[rows_of][:, None] + np.arange(size_of[rows_of[0]])], end
                n, s, m = held.get(k, (0, 0.0, 0.0))
                size += 0 if n else part.shape[1] ** 2
                held[k] = n + len(part), s + part.sum(0), m + part.T @ part
            if size > _HELD:
                for k, v in held.items():
                    yield table(list(blocks(k, *v)), arrow)
                held, size = {}, 0
        for k, v in held.items():
            yield table(list(blocks(k, *v)), arrow)

    def add(t: pa.Table) -> pa.Table:
        total = lambda c: np.stack([x.values.to_numpy() for x in t[c]]).sum(0)
        one = t.slice(0, 1)
        out = {key: one[key], "first": one["first"], "n": pa.array([sum(t["n"].to_pylist())], pa.int64())}
        return pa.table(out | {c: pa.array([total(c)], pa.list_(pa.float64())) for c in ("sums", "products")})

    numbers = ArrayType(DoubleType())
    schema = StructType([StructField(key, kind), StructField("first", IntegerType()), StructField("n", LongType()), StructField("sums", numbers), StructField("products", numbers)])
    return rows.select(key, vector).mapInArrow(partial, schema).groupBy(key, "first").applyInArrow(add, schema)


def covariances(moments: DataFrame, key: str, degrees: int = 0) -> DataFrame:
    """(key, a, b, n, cov) of all places a and b in the vectors; ``degrees``: 1 for the sample covariance."""
    d = F.size("sums")
    cells = moments.select(key, "first", "n", "sums", d.alias("d"), F.posexplode("products").alias("place", "sxy"))
    a, b = (F.col("first") + F.floor(F.col("place") / F.col("d"))).cast("int"), F.col("place") % F.col("d")
    cov = F.try_divide(F.col("sxy") - F.col("sums")[F.col("a")] * F.col("sums")[F.col("b")] / F.col("n"), F.col("n") - degrees)
    return cells.withColumns({"a": a, "b": b}).select(key, "a", "b", "n", cov.alias("cov"))


def matrix_of(t: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    """(number, means, population covariance) from all the ``second_moments`` rows of one key."""
    t = t.sort_by("first")
    n, sums = t["n"][0].as_py(), t["sums"][0].values.to_numpy()
    m = np.concatenate([x.values.to_numpy() for x in t["products"]]).reshape(len(sums), -1)
    mean = sums / n
    return n, mean, m / n - np.outer(mean, mean)


def vectors_of(features: DataFrame, key: str, order: str, name: str = "j", value: str = "x") -> tuple[DataFrame, DataFrame]:
    """(key, order, vector) of long features, and (key, names): which feature stands at each place. Rows that lack a feature of their key are left out."""
    rows = features.groupBy(key, order).agg(F.array_sort(F.collect_list(F.struct(name, value))).alias("pairs"))
    names = features.groupBy(key).agg(F.array_sort(F.collect_set(name)).alias("names"))
    full = rows.join(names, key).where(F.size("pairs") == F.size("names"))
    return full.select(key, order, F.col(f"pairs.{value}").alias("vector")), names
