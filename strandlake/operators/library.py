"""Over the whole library: basins of replicas, balanced components of feature blocks, and the map of complexes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.kernels import linear
from strandlake.kernels.alignment import align_pairs
from strandlake.operators import moments
from strandlake.operators.geometry import stack
from strandlake.operators.summaries import exact_quantiles
from strandlake.session import materialize


def basin_distances(basins: DataFrame, key: str) -> DataFrame:
    """How near the basins of a complex's replicas are to each other, by fitted RMSD of their representative frames.

    basins: (key, run, basin, population, xyz), a few per run. Of each complex with two runs or more: median distance to the nearest basin of the own and of
    another run, the latter's mean by population and largest, the median distance within runs, and how many basins' nearest neighbour is of another run, beside
    what chance gives. Complexes whose frames differ in atoms have only ``ok`` false and the counts."""
    named = basins.withColumn("id", F.struct("run", "basin"))
    g = named.groupBy(key).agg(F.countDistinct("run").alias("n_rep"), F.count("*").alias("n_basins"), F.countDistinct(F.size("xyz")).alias("shapes")).where("n_rep >= 2")
    good = named.join(g.where("shapes = 1").select(key), key)
    one = good.select(key, F.col("id").alias("a"), F.col("xyz").alias("x1"))
    two = good.select(key, F.col("id").alias("b"), F.col("xyz").alias("x2"))
    pairs = one.join(two, key).where("a < b")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            d = [float(linear.fitted_rmsd(stack(r["x1"].slice(i, 1)), stack(r["x2"].slice(i, 1)))[0, 0]) for i in range(r.num_rows)]
            yield pa.RecordBatch.from_arrays([r[key], r["a"], r["b"], pa.array(d, pa.float64())], [key, "a", "b", "d"])

    half = pairs.select(key, "a", "b", "x1", "x2")
    schema = half.drop("x1", "x2").withColumn("d", F.lit(0.0)).schema
    dist = materialize(half.mapInArrow(measure, schema), "basins")
    both = dist.union(dist.select(key, F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    own = F.col("a.run") == F.col("b.run")
    near = both.groupBy(key, "a").agg(F.min(F.when(own, F.col("d"))).alias("own"), F.min(F.when(~own, F.col("d"))).alias("cross"), F.min(F.struct("d", "b")).alias("next"), F.count_if(~own).alias("n_cross"), F.count("*").alias("n_all"))
    w = good.select(key, F.col("id").alias("a"), F.coalesce("population", F.lit(0.0)).alias("population"))
    near = near.join(w, [key, "a"])
    weight = F.sum("population")
    s = near.groupBy(key).agg(
        F.median("own").alias("d_self"),
        F.median("cross").alias("d_cross"),
        (F.sum(F.col("cross") * F.col("population")) / F.when(weight == 0, 1.0).otherwise(weight)).alias("near_w"),
        F.max("cross").alias("near_max"),
        F.count_if(F.col("next.b.run") != F.col("a.run")).alias("hit"),
        F.sum(F.col("n_cross") / F.col("n_all")).alias("expected"),
    )
    within = dist.where(own).groupBy(key).agg(F.median("d").alias("within_pair"))
    return g.select(key, "n_rep", "n_basins", (F.col("shapes") == 1).alias("ok")).join(s, key, "left").join(within, key, "left")


def _oriented(vectors: np.ndarray) -> np.ndarray:
    """Columns with their largest entry positive."""
    return vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def balanced_components(rows: DataFrame, blocks: dict[str, int], n: int = 2, key: str = "traj_id", order: str = "frame", vector: str = "vector") -> DataFrame:
    """(key, order, component, score, share): principal components of vectors made of feature blocks, each centred and divided by its first singular value, so that
    none outweighs the others. ``blocks``: name and width, in the vector's order. Signs: the largest loading is positive.

    All that is needed is each key's covariance, summed by Spark; its task finds the blocks' scales and the joint components from that matrix."""
    widths = list(blocks.values())

    def decompose(t: pa.Table) -> pa.Table:
        count, mean, cov = moments.matrix_of(t)
        scale, at = np.ones(len(mean)), 0
        for width in widths:
            first = np.sqrt(max(np.linalg.eigvalsh(cov[at : at + width, at : at + width])[-1], 0.0) * count)
            scale[at : at + width] = 1 / first if first > 1e-9 else 1.0
            at += width
        w, v = np.linalg.eigh(cov * np.outer(scale, scale))
        w, v = np.maximum(w[::-1], 0), _oriented(v[:, ::-1][:, :n])
        k = v.shape[1]
        lists = pa.list_(pa.float64())
        load = (v * scale[:, None]).T
        return pa.table({key: pa.concat_arrays([t[key].slice(0, 1).combine_chunks()] * k), "component": pa.array(range(k), pa.int32()), "share": pa.array(w[:k] / (w.sum() or 1.0)), "mean": pa.array([mean] * k, lists), "loading": pa.array(list(load), lists)})

    kind = rows.schema[key].dataType.simpleString()
    sums = moments.second_moments(rows, key, vector)
    load = sums.groupBy(key).applyInArrow(decompose, f"{key} {kind}, component int, share double, mean array<double>, loading array<double>")
    score = F.aggregate(F.zip_with(F.zip_with(F.col(vector), "mean", lambda x, m: x - m), "loading", lambda d, v: d * v), F.lit(0.0), lambda a, x: a + x)
    return rows.join(load, key).select(key, order, "component", score.alias("score"), "share")


def robust_scaled(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, vector): each column less its median over its quartile range (1 if that is nothing), null as 0. The quantiles are exact, from a distributed sort."""
    long = rows.select(F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns))))
    q = exact_quantiles(long, "name", "v", (0.25, 0.5, 0.75)).groupBy("name").agg(*(F.max(F.when(F.col("q") == x, F.col("value"))).alias(n) for x, n in ((0.25, "lo"), (0.5, "mid"), (0.75, "hi"))))
    scale = {r["name"]: (r["mid"], r["hi"] - r["lo"] if r["hi"] - r["lo"] >= 1e-9 else 1.0) for r in q.collect()}  # a row per column
    z = [F.coalesce((F.col(c).cast("double") - scale[c][0]) / scale[c][1], F.lit(0.0)) if c in scale else F.lit(0.0) for c in columns]
    return rows.select(key, F.array(*z).alias("vector"))


def places(i: np.ndarray, n: int, keys: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Where each of the numbers ``i`` below ``n`` goes under the pseudo-random permutation of each of the 64-bit ``keys``: shape keys + i. Halves of the bits are mixed
    into each other by turns, and what leaves the range is sent on until it is back."""
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    mask = np.uint64((1 << half) - 1)
    out = np.broadcast_to(i.astype(np.uint64), (*keys.shape, len(i))).copy()
    key = np.broadcast_to(keys[..., None].astype(np.uint64), out.shape)
    todo = np.ones(out.shape, bool)
    while todo.any():
        left, right, k = out[todo] >> np.uint64(half), out[todo] & mask, key[todo]
        for r in range(rounds):
            x = (right + k + np.uint64(r + 1)) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((x ^ (x >> np.uint64(32))) & mask)
        out[todo] = left << np.uint64(half) | right
        todo &= out >= n
    return out.astype(np.int64)


def permuted_spectra(rows: DataFrame, vector: str, spans: list[slice], draws: int = 200, seed: int = 7, range_bytes: int = 256 << 20) -> np.ndarray:
    """Eigenvalues (draws, columns of the spans, falling) of each span's covariance after every column is permuted by itself.

    Rows are numbered once. Each value moves once, to its place under one permutation of its column over all rows, by ranges of places; a range's task then permutes
    its part of every column anew for each draw and adds up the outer products. So each draw permutes whole columns, draws differ by all that ranges hold (of their
    own means, one part in a range's rows, they share the order), and what moves and what a task holds does not grow with the draws."""
    numbered = materialize(rows.select(F.col(vector).alias("x"), F.monotonically_increasing_id().alias("i")), "numbered")
    part = F.shiftright("i", 33)
    counts = {r.p: r.n for r in numbered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # a number per written partition
    n, p = sum(counts.values()), max(s.stop for s in spans)
    if not n:
        return np.zeros((draws, p))
    first = dict(zip(sorted(counts), np.cumsum([0, *(counts[k] for k in sorted(counts))]).tolist()))
    keys = np.random.default_rng(seed).integers(0, 1 << 63, p)
    size = max(1, range_bytes // (8 * draws * p))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b["i"].to_numpy()
            i = np.array([first[k] for k in (raw >> 33).tolist()], np.int64) + (raw & ((1 << 33) - 1))
            x = b["x"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)[:, :p]
            to = places(i, n, keys)  # column, row
            column = np.repeat(np.arange(p), len(i))
            to, value = to.ravel(), x.T.ravel()
            by = np.argsort(to // size, kind="stable")
            number = (to // size)[by]
            cut = np.append(np.flatnonzero(np.append(True, number[1:] != number[:-1])), len(number)) if len(number) else np.zeros(1, int)
            lists = [[v[by][s:e] for s, e in zip(cut[:-1], cut[1:])] for v in (column, to % size, value)]
            yield pa.RecordBatch.from_arrays([pa.array(number[cut[:-1]]), *(pa.array(v, pa.list_(t)) for v, t in zip(lists, (pa.int32(), pa.int64(), pa.float64())))], ["range", "cell", "place", "value"])

    def products(t: pa.Table) -> pa.Table:
        number = t["range"][0].as_py()
        x = np.zeros((p, min(size, n - number * size)))
        for k in range(t.num_rows):
            x[t["cell"][k].values.to_numpy(), t["place"][k].values.to_numpy()] = t["value"][k].values.to_numpy()
        rng, sums, m = np.random.default_rng([seed, number]), x.sum(1), np.empty((draws, p * p))
        for draw in range(draws):
            y = rng.permuted(x, axis=1)
            m[draw] = (y @ y.T).ravel()
        return pa.table({"draw": np.arange(draws), "m": pa.array(list(m), pa.list_(pa.float64())), "s": pa.array([sums] * draws, pa.list_(pa.float64()))})

    def spectra(t: pa.Table) -> pa.Table:
        m, s = (np.sum([v.values.to_numpy() for v in t[c]], axis=0) for c in ("m", "s"))
        cov = m.reshape(p, p) / n - np.outer(s, s) / n**2
        out = np.concatenate([np.linalg.eigvalsh(cov[span, span])[::-1] for span in spans])
        return pa.table({"draw": t["draw"][:1], "w": pa.array([out], pa.list_(pa.float64()))})

    sent = numbered.mapInArrow(send, "range long, cell array<int>, place array<long>, value array<double>")
    sums = sent.groupBy("range").applyInArrow(products, "draw long, m array<double>, s array<double>")
    found = sums.groupBy("draw").applyInArrow(spectra, "draw long, w array<double>").collect()  # draws times columns
    return np.array([r.w for r in sorted(found, key=lambda r: r.draw)])


def noise_rank(cov: np.ndarray, null: np.ndarray, percentile: float = 95) -> int:
    """Components whose variance exceeds that of the same columns permuted (eigenvalues of the draws), by parallel analysis; one at least."""
    return max(1, int((np.linalg.eigvalsh(cov)[::-1] > np.percentile(null, percentile, axis=0)).sum()))


def library_map(rows: DataFrame, key: str, blocks: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """A map of complexes from blocks of features: (key, pc1, pc2), and (block, feature, pc1, pc2, share_1, share_2) with each feature's correlation with both axes
    and its block's share in them.

    Features are scaled robustly; each block gives its components above noise, divided by the first one's singular value; the map is their joint principal
    components. Signs: the largest correlation is positive. Everything but the scores follows from one small covariance matrix."""
    columns = [c for cs in blocks.values() for c in cs]
    z = materialize(robust_scaled(rows, key, columns), "scaled").withColumn("_all", F.lit("all"))
    table = moments.second_moments(z, "_all", "vector").toArrow()  # one matrix over the columns
    n, mean, cov = moments.matrix_of(table)
    ends = np.cumsum([len(cs) for cs in blocks.values()]).tolist()
    spans = [slice(a, b) for a, b in zip([0, *ends], ends)]
    null = permuted_spectra(z, "vector", spans)
    parts, owner = [], []
    for (name, _), span in zip(blocks.items(), spans):
        w, v = np.linalg.eigh(cov[span, span])
        k = noise_rank(cov[span, span], null[:, span])
        part = np.zeros((len(columns), k))
        part[span] = v[:, ::-1][:, :k] / np.sqrt(max(w[-1], 1e-300) * n)
        parts.append(part)
        owner += [name] * k
    to = np.concatenate(parts, 1)
    w, v = np.linalg.eigh(to.T @ cov @ to)
    v = v[:, ::-1][:, :2]
    load = to @ v
    spread = np.sqrt(np.maximum(np.diag(load.T @ cov @ load), 0))
    scale = np.outer(np.sqrt(np.diag(cov)), spread)
    corr = np.where(scale > 1e-12, (cov @ load) / np.where(scale > 1e-12, scale, 1), 0.0)
    sign = np.where(corr[np.abs(corr).argmax(0), np.arange(corr.shape[1])] < 0, -1.0, 1.0)
    corr, load = corr * sign, load * sign
    score = lambda k: sum(((F.col("vector")[i] - float(mean[i])) * float(load[i, k]) for i in range(len(columns))), F.lit(0.0))
    pcs = range(load.shape[1])
    points = z.select(key, *(score(k).alias(f"pc{k + 1}") for k in pcs))
    share = {b: [float((v[[i for i, o in enumerate(owner) if o == b], k] ** 2).sum()) for k in pcs] for b in blocks}
    out = [(b, c, *(float(corr[columns.index(c), k]) for k in pcs), *share[b]) for b, cs in blocks.items() for c in cs]
    fields = ["block string", "feature string", *(f"pc{k + 1} double" for k in pcs), *(f"share_{k + 1} double" for k in pcs)]
    return points, rows.sparkSession.createDataFrame(out, ", ".join(fields))


def best_matches(
    queries: DataFrame, references: DataFrame, top: int = 3, scores: tuple[float, float, float, float] = (2.0, -1.0, -6.0, -1.0), key: str = "query_id",
    block_letters: int = 500_000, most_broadcast: int = 32_000_000,
) -> DataFrame:
    """The ``top`` references of each query sequence by identity, coverage and score of their global alignment, with a confidence label.

    queries: (key, sequence); references: (allele, locus, sequence), the typing library. Every distinct query sequence is aligned to every distinct reference: an alignment that
    scores best may leave most letters in gaps, so neither shared k-mers nor lengths bound its identity. References are packed into blocks of some ``block_letters``; a
    task meets a query with a block, aligns the lot and sends the block's best alone. Blocks are broadcast if the library has at most ``most_broadcast`` letters, else joined by a
    shuffle over which queries are dealt evenly.

    Identity: equal places over places without a gap, 0 without such. Of equal identity, coverage and score the lesser allele comes first. A null sequence has no rows and is no reference;
    an empty one covers nothing. Sequences of a million letters or more are an error."""
    library = materialize(references.where("sequence IS NOT NULL").groupBy("sequence").agg(F.array_sort(F.collect_set(F.struct("allele", "locus"))).alias("names")), "library")
    letters = library.agg(F.coalesce(F.sum(F.length("sequence") + 1), F.lit(0)).alias("n")).first()["n"]
    n_blocks = max(1, -(-letters // block_letters))
    packed = library.groupBy(F.pmod(F.xxhash64("sequence"), F.lit(n_blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("sequence", "names")).alias("references"))
    asked = queries.where("sequence IS NOT NULL").select(F.col("sequence").alias("q")).distinct().withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    if letters <= most_broadcast:
        met = asked.join(F.broadcast(packed), "block")
    else:
        salts = 1000
        dealt = packed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = asked.withColumn("_salt", F.pmod(F.xxhash64("q"), F.lit(salts)).cast("int")).join(dealt.hint("shuffle_merge"), ["block", "_salt"])
    kind = "q string, allele string, locus string, identity double, coverage double, score double"

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list] = {}
        for b in batches:
            out = []
            for i in range(b.num_rows):
                q, block = b["q"][i].as_py(), b["block"][i].as_py()
                if block not in known:
                    known[block] = [(r["sequence"], [(x["allele"], x["locus"]) for x in r["names"]]) for r in b["references"][i].as_py()]
                got = align_pairs([q] * len(known[block]), [t for t, _ in known[block]], *scores)
                identity = np.where(got[:, 2] > 0, got[:, 1] / np.maximum(got[:, 2], 1), 0.0)
                best = np.lexsort((-got[:, 0], -identity))  # the coverage is the query's
                kept, names = 0, []
                for k in best.tolist():  # all alleles of equal rank, until there are enough
                    if kept >= top and (identity[k], got[k, 0]) != (identity[last], got[last, 0]):
                        break
                    last, kept = k, kept + len(known[block][k][1])
                    names += [(q, a, locus, identity[k], float(bool(q)), got[k, 0]) for a, locus in known[block][k][1]]
                names.sort(key=lambda r: (-r[3], -r[5], r[1] is not None, r[1]))
                out += names[:top]
            fields = [pa.string()] * 3 + [pa.float64()] * 3
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(fields)], [f.split()[0] for f in kind.split(", ")])

    done = met.select("q", "block", "references").mapInArrow(align, kind)
    rows = queries.select(key, "sequence").join(done, F.col("sequence") == F.col("q")).drop("sequence", "q")
    order = W.partitionBy(key).orderBy(F.desc("identity"), F.desc("coverage"), F.desc("score"), "allele")
    level = F.when((F.col("identity") >= 0.98) & (F.col("coverage") >= 0.95), "high").when((F.col("identity") >= 0.94) & (F.col("coverage") >= 0.90), "medium").otherwise("low")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("confidence", level)
