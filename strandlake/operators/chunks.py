"""Series of any length in chunks: places, windows and running values without one task for a whole series.

A series (key, order) is cut at multiples of ``span`` of its order column, so a chunk of frames has at most ``span`` different ones. What a
chunk needs from the others is one row of counts, sums or ends per chunk; only those rows meet in a window over the series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPAN = 65536


def cut(rows: DataFrame, order: str, span: int = SPAN) -> DataFrame:
    """Add chunk. Rows of a null order are left out: they have no place."""
    return rows.where(F.col(order).isNotNull()).withColumn("chunk", F.floor(F.col(order) / span))


def carry(rows: DataFrame, key: str, values: dict[str, Column], how=F.sum, ahead: bool = False) -> DataFrame:
    """Add per value <name>_before, its aggregate over all earlier chunks (``ahead``: later ones), and <name>_all, that over the series.

    ``how``: F.sum, F.min or F.max. The last row of earlier chunks is the greatest struct of order and columns, the next one the least."""
    parts = rows.groupBy(key, "chunk").agg(*(how(v).alias(name) for name, v in values.items()))
    series = W.partitionBy(key)
    others = series.orderBy(F.desc("chunk") if ahead else F.col("chunk")).rowsBetween(W.unboundedPreceding, -1)
    known = [c for name in values for c in (how(name).over(others).alias(f"{name}_before"), how(name).over(series).alias(f"{name}_all"))]
    return rows.join(parts.select(key, "chunk", *known), [key, "chunk"])


def running(rows: DataFrame, key: str, order: str, values: dict[str, Column], how=F.sum, ahead: bool = False) -> DataFrame:
    """Add per name the value's aggregate over the row and all before it (``ahead``: all after it): the chunk's own and what it carries."""
    given = rows.withColumns({f"{name}_row": v for name, v in values.items()})
    own = W.partitionBy(key, "chunk").orderBy(F.desc(order) if ahead else F.col(order)).rowsBetween(W.unboundedPreceding, 0)
    both = carry(given, key, {name: F.col(f"{name}_row") for name in values}, how, ahead)
    join = {F.sum: lambda a, b: F.coalesce(a + b, a, b), F.min: F.least, F.max: F.greatest}[how]
    done = both.withColumns({name: join(how(f"{name}_row").over(own), F.col(f"{name}_before")) for name in values})
    return done.drop(*(f"{name}{end}" for name in values for end in ("_row", "_before", "_all")))


def numbered(rows: DataFrame, key: str, order: str, mean: str | None = None, span: int = SPAN) -> DataFrame:
    """Add chunk, i, the place from 0, and n, the rows of the series; ``mean`` names a column whose mean over the series is added as mean.

    Rows of one order value are numbered in any order."""
    values = {"_n": F.lit(1)} | ({"_s": F.col(mean), "_k": F.col(mean).isNotNull().cast("long")} if mean else {})
    out = carry(cut(rows, order, span), key, values)
    place = F.coalesce("_n_before", F.lit(0)) + F.row_number().over(W.partitionBy(key, "chunk").orderBy(order)) - 1
    out = out.withColumns({"i": place.cast("long"), "n": F.col("_n_all").cast("long")})
    if mean:
        out = out.withColumn("mean", F.try_divide("_s_all", "_k_all"))
    return out.drop(*(f"{name}{end}" for name in values for end in ("_before", "_all")))


def haloed(rows: DataFrame, before: int = 0, after: int = 0, size: int = SPAN) -> DataFrame:
    """Numbered rows dealt into blocks of ``size`` places; a row also goes to the blocks that look ``before`` places back or ``after`` ahead to it. own: in its own block."""
    block = lambda place: F.floor(place / size)
    reach = F.sequence(block(F.greatest(F.col("i") - after, F.lit(0))), block(F.least(F.col("i") + before, F.col("n") - 1)))
    return rows.withColumn("block", F.explode(reach)).withColumn("own", F.col("block") == block(F.col("i")))
