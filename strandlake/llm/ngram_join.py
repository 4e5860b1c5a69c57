"""Exact Jaccard self-join of documents over word n-grams, by T-occurrence search.

1. Every document's distinct shingles are counted over the corpus by key ranges (``blocks``). A document that can link holds
   at least the threshold's share of shingles that another document holds too; all others are done here, which ends every
   search for documents that share no more than a passage.
2. Documents with equal shingle sets become one class, for which its smallest identifier stands.
3. Prefix filter in the order of corpus frequency, rarest first: two linked classes share a shingle of both prefixes. A shingle's
   pivot is the smallest class that has it in its prefix, and classes gather by pivot, so linked classes meet in a
   group and a class is in few groups. Groups larger than ``group`` are cut into blocks, each searched beside the pivot. What
   that leaves outside the group's largest component, and only that, is searched against the group's other blocks.
4. In a group DivideSkip finds each class's partners: the longest inverted lists are set aside, the others are merged in a heap,
   and a class that occurs often enough is looked up in the long lists by binary search. Classes
   already connected are not tested again: what is wanted is the components, and a spanning forest of the links has them.
5. Connected components by alternating minimum labels over the forest's edges.

Null and empty texts have no shingles and link with nothing. A text of fewer words than ``n`` is one shingle. Repeated identifiers
are one document with several texts for ``link_components``; ``drop_near`` tells rows apart by identifier and content and keeps
one of rows repeated whole. Hashes are 64 bits wide.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from itertools import groupby
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from strandlake.llm.blocks import into_blocks, with_totals
from strandlake.llm.components import components
from strandlake.llm.hashing import Words, mix
from strandlake.llm.tables import bytes_of, loose
from strandlake.session import materialize

MU = 0.01  # DivideSkip's weight of a probe against a merge


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Each text's ascending distinct shingle hashes."""
    words = Words(texts, lower=True)
    hashes, first = words.windows(n)
    at = np.searchsorted(first, words.at)
    out = []
    for i in range(len(texts)):
        a, b = words.at[i], words.at[i + 1]
        if 0 < b - a < n:
            x = np.array([b - a], np.uint64)
            for h in words.hashes[a:b]:
                x = mix(x ^ h)
            out.append(x)
        else:
            out.append(np.unique(hashes[at[i] : at[i + 1]]))
    return out


def needed(size: int, percent: int) -> int:
    """The least overlap of a set of ``size`` with any set no larger that it links with."""
    return -(-percent * size // 100)


def prefix(tokens: np.ndarray, totals: np.ndarray, percent: int) -> np.ndarray | None:
    """The shared shingles in the prefix, rarest first; none if too few are shared for any link.

    A link needs ``needed`` shared shingles also of the smaller side, so the prefix has size - needed + 1 of them."""
    spare = len(tokens) - needed(len(tokens), percent)
    alone = int((totals < 2).sum())
    if alone > spare:
        return None
    order = np.lexsort((tokens, totals))
    return tokens[order[alone : spare + 1]]


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def divide_skip(sets: list[np.ndarray], percent: int, known: list | None = None, sides: list[bool] | None = None) -> list[tuple[int, int]]:
    """Edges that, with those implied by equal ``known`` labels, span the links among ``sets``, which ascend in size.

    With ``sides`` only pairs of different sides are looked for, and the true side is one component already."""
    index: tuple[dict[int, list[int]], ...] = ({}, {}) if sides else ({},)
    forest, edges = Forest(len(sets)), []
    first: dict = {}
    for x, label in enumerate(known or ()):
        forest.join(x, first.setdefault(label, x))
    whole = sides.index(True) if sides and True in sides else None
    roots: set[int] = set()  # of the sets up to this one
    for x, tokens in enumerate(sets):
        roots.add(forest.root(x))
        single = whole is not None and not sides[x]
        if single and forest.root(x) == forest.root(whole):
            continue  # nothing of the other side is new to it, nor it to them
        lists, own = (index[not sides[x]], index[sides[x]]) if sides else (index[0], index[0])
        tokens = tokens.tolist()
        size = len(tokens)
        t = needed(size, percent)  # partners are no larger, so the overlap is at least this
        mine = sorted((lists[k] for k in tokens if k in lists), key=len) if len(roots) > 1 else ()
        if len(mine) >= t and size:
            skip = min(t - 1, ceil(t / (MU * log2(max(2, len(mine[-1]))) + 1)), len(mine))
            short, long_ = mine[: len(mine) - skip], mine[len(mine) - skip :]
            for y, same in groupby(heapq.merge(*short)):
                if len(roots) == 1:
                    break
                n = sum(1 for _ in same)
                if n < t - skip or 100 * len(sets[y]) < percent * size or forest.root(x) == forest.root(y):
                    continue
                for k in long_:
                    i = bisect_left(k, y)
                    n += i < len(k) and k[i] == y
                if 100 * n >= percent * (size + len(sets[y]) - n):
                    roots.discard(max(forest.root(x), forest.root(y)))
                    forest.join(x, y)
                    edges.append((x, y))
                    if single:
                        break
        for k in tokens:
            own.setdefault(k, []).append(x)
    return edges


def link_components(
    docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", group: int = 300, block_bytes: int | None = None, range_keys: int | None = None
) -> DataFrame:
    """(id, n_shingles, component_id) of each row."""
    kind = loose(docs.schema[id_col].dataType)

    def keys_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        sets = shingle_sets(bytes_of(t["text"]), n)
        return np.unique(np.concatenate(sets), return_counts=True)

    def answer(t: pa.Table, keys: np.ndarray, totals: np.ndarray) -> pa.Table:
        texts = bytes_of(t["text"])
        size, high, low, pre, kept = [], [], [], [], []
        for text, tokens in zip(texts, shingle_sets(texts, n)):
            p = prefix(tokens, totals[np.searchsorted(keys, tokens)], percent) if len(tokens) else None
            size.append(len(tokens))
            high.append(None if p is None else int(mix(tokens).sum(dtype=np.uint64).view(np.int64)))
            low.append(None if p is None else int(mix(~tokens).sum(dtype=np.uint64).view(np.int64)))
            pre.append(None if p is None else p.view(np.int64))
            kept.append(None if p is None else text.decode())
        return pa.table(
            {
                "id": t["id"],
                "n_shingles": pa.array(size, pa.int64()),
                "high": pa.array(high, pa.int64()),
                "low": pa.array(low, pa.int64()),
                "prefix": pa.array(pre, pa.list_(pa.int64())),
                "text": pa.array(kept, pa.string()),
            }
        )

    rows, size = into_blocks(docs, id_col, text_col, block_bytes)
    schema = StructType.fromDDL("n_shingles long, high long, low long, prefix array<long>, text string")
    schema = StructType([StructField("id", kind), *schema.fields])
    seen = materialize(with_totals(rows, size, keys_of, answer, schema, range_keys), "shingles")
    able = seen.where("high IS NOT NULL")
    classes = able.groupBy("n_shingles", "high", "low").agg(F.min("id").alias("rep"))
    first = classes.select(F.col("rep").alias("id")).distinct()
    reps = able.join(first, "id", "left_semi").dropDuplicates(["id", "high", "low"])
    postings = reps.select("id", F.explode("prefix").alias("token"))
    pivots = postings.groupBy("token").agg(F.min("id").alias("pivot"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = materialize(postings.join(pivots, "token").select("pivot", "id").distinct(), "members")
    sizes = members.groupBy("pivot").agg(F.count("*").alias("m")).where("m > 1").withColumn("cuts", F.ceil(F.col("m") / group).cast("int"))
    sizes = materialize(sizes, "sizes")
    texts = reps.select("id", "text")

    def search(t: pa.Table) -> pa.Table:
        # a class may come with two texts only if identifiers repeat
        sets, ids = shingle_sets(bytes_of(t["text"]), n), t["id"].to_pylist()
        label, side = t["label"].to_pylist(), t["side"].to_pylist()
        order = sorted(range(len(ids)), key=lambda i: len(sets[i]))
        pick = lambda x: [_key(x[i]) for i in order]
        known = pick(label) if label[0] is not None else None
        edges = divide_skip([sets[i] for i in order], percent, known, pick(side) if side[0] is not None else None)
        # a star for each tree: components over many tasks then need few rounds
        forest = Forest(len(order))
        for i, j in edges:
            forest.join(i, j)
        edges = [(i, r) for i in sorted({i for e in edges for i in e}) if (r := forest.root(i)) != i]
        ends = (pa.array([order[e[j]] for e in edges], pa.int64()) for j in (0, 1))
        return pa.table({k: t["id"].take(x) for k, x in zip(("src", "dst"), ends)}).cast(arrow)

    edge = StructType([StructField("src", kind), StructField("dst", kind)])
    arrow = to_arrow_schema(edge)

    def links(placed: DataFrame) -> DataFrame:
        """Edges found in the tasks (pivot, a, b) of (pivot, a, b, id, label, side)."""
        tasks = placed.join(texts, "id").select("pivot", "a", "b", "id", "text", "label", "side")
        # a given number: few bytes are much work here, and must not be put together by their size
        tasks = tasks.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "pivot", "a", "b")
        return materialize(tasks.groupBy("pivot", "a", "b").applyInArrow(search, edge).distinct(), "edges")

    cut = F.expr("cast(pmod(xxhash64(id), cuts) as int)")
    dealt = members.join(sizes, "pivot")
    hubs = sizes.where("cuts > 1").select("pivot", F.explode(F.expr("sequence(0, cuts - 1)")).alias("a"), F.col("pivot").alias("id"))
    none = [F.lit(0).alias("b"), F.lit(None).cast(kind).alias("label"), F.lit(None).cast("boolean").alias("side")]
    near = dealt.select("pivot", cut.alias("a"), "id").union(hubs).distinct().select("pivot", "a", "id", *none)
    edges = links(near)
    labels = components(edges)
    if not sizes.where("cuts > 1").isEmpty():
        more = links(_across(dealt.where("cuts > 1").select("pivot", "id"), labels, group))
        if not more.isEmpty():
            labels = _merged(materialize(labels, "labels"), more)
    by_class = classes.join(labels, classes["rep"] == labels["node"], "left").select("n_shingles", "high", "low", F.coalesce("label", "rep").alias("component"))
    # classes of copies differ in size: the class side has one row each, and AQE splits the other
    return (
        seen.drop("text", "prefix")
        .join(by_class, ["n_shingles", "high", "low"], "left")
        .select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"))
    )


def _merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels of the components that further edges make of (node, label): the components of a graph of labels."""
    for end in ("src", "dst"):
        known = labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"))
        edges = edges.join(known, end, "left").withColumn(f"{end}_label", F.coalesce(f"{end}_label", end))
    edges = materialize(edges, "merges")
    alone = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))
    whole = components(edges.select(F.col("src_label").alias("src"), F.col("dst_label").alias("dst"))).select(F.col("node").alias("label"), F.col("label").alias("whole"))
    return labels.union(alone).join(whole, "label", "left").select("node", F.coalesce("whole", "label").alias("label"))


def _key(x):
    return tuple(x.values()) if isinstance(x, dict) else x


def _across(big: DataFrame, labels: DataFrame, group: int) -> DataFrame:
    """Tasks that bring each member outside the largest component of its group together with all members it has not met."""
    label = F.coalesce("label", "id").alias("label")
    known = materialize(big.join(labels.withColumnRenamed("node", "id"), "id", "left").select("pivot", "id", label), "known")
    most = known.groupBy("pivot", "label").agg(F.count("*").alias("n")).groupBy("pivot").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("m"))
    most = most.select("pivot", F.col("top.label").alias("top"), F.expr(f"cast(ceil((m - top.n) / {group}) as int)").alias("others"), F.expr(f"cast(ceil(top.n / {group}) as int)").alias("cuts"))
    sided = known.join(most.where("others > 0"), "pivot").withColumn("side", F.col("label") == F.col("top"))
    place = lambda k: F.expr(f"cast(pmod(xxhash64(id), {k}) as int)")
    few, many = sided.where("NOT side"), sided.where("side")
    met = few.withColumn("o", F.explode(F.expr("sequence(0, others - 1)"))).select(
        "pivot", F.least(place("others"), "o").alias("a"), F.greatest(place("others"), "o").alias("b"), "id", "label", F.lit(None).cast("boolean").alias("side")
    )
    # blocks of the largest component are numbered below zero
    out = few.withColumn("o", F.explode(F.expr("sequence(0, cuts - 1)"))).select("pivot", place("others").alias("a"), (-1 - F.col("o")).alias("b"), "id", "label", "side")
    back = many.withColumn("o", F.explode(F.expr("sequence(0, others - 1)"))).select("pivot", F.col("o").alias("a"), (-1 - place("cuts")).alias("b"), "id", "label", "side")
    return met.union(out).union(back)


def drop_near(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row that stands for each component (its smallest identifier), with all its columns."""
    key = F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.coalesce(f"`{text_col}`", F.lit(""))).alias("content"))
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key.alias("key"), F.col(f"`{text_col}`").alias("content"))
    found = link_components(keyed.select("key", "content"), n, percent, "key", "content")
    stay = found.where(F.col("key") == F.col("component_id")).select("key").distinct()
    return keyed.join(stay, "key").dropDuplicates(["key"]).select("row.*")
